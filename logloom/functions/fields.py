"""Log fields as column expressions over :class:`~logloom.functions.draws.Draws`.

Each row key owns nine words; a field reads a fixed bit range, so two formats
rendered from the same row agree on every shared field:

    word 0  address 16 | path 16 | agent 8 | method 8 | protocol 8 | referrer 8
    word 1  user 8 | service 8 | host 8 | level 8 | error roll 24 | coin 8
    word 2  status slot 8 | size class 8 | size 32 | clock jitter 8 | (free 8)
    word 3  duration 32 | request size 32
    word 4  trace id 64
    word 5  span id 32 | message id 32
    word 6  request id 64
    word 7  process id 32 | syslog duration 32
    word 8  request time 24 | syslog roll 24 | syslog coin 8 | (free 8)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .draws import Draws, pick, weighted

N_WORDS = 9

#: Words that a field reads, and the fields that it is made from.
FIELD_WORDS = {
    "ip": (0,), "path": (0,), "user_agent": (0,), "method": (0,), "protocol": (0,), "referrer": (0,), "username": (1,),
    "service": (1,), "host": (1,), "_status": (1, 2), "_drawn_level": (1,), "body_bytes": (2,), "request_time": (8,),
    "trace_id": (4,), "span_id": (5,), "request_id": (6,), "msg_id": (5,), "pid": (7,), "duration_ms": (3,),
    "request_size": (3,), "syslog_level": (8,), "syslog_duration_ms": (7,), "event_epoch": (2,),
}
FIELD_PARTS = {
    "status": ("_status",), "body_bytes": ("_status",), "request_time": ("_status",), "duration_ms": ("_status",),
    "message": ("_status",), "level": ("_status", "_drawn_level"), "syslog_level": ("_drawn_level",),
}


# -- D3, D4, D5, D6, D7, D8, D9, D10: categorical fields -------------------------------------
def error_roll(d: Draws) -> Column:
    return d.unit(1, 32)


def http_status(d: Draws, error_rate: Column) -> Column:
    """Status code: the roll picks error or success, the coin 4xx or 5xx, the slot the code."""
    slot = d.u8(2, 0)
    error = F.when(d.coin(1, 56), weighted(slot, V.CLIENT_ERROR_CODES)).otherwise(weighted(slot, V.SERVER_ERROR_CODES))
    return (
        F.when(error_roll(d) < error_rate.cast("float"), error).otherwise(weighted(slot, V.SUCCESS_CODES)).cast("int")
    )


def http_method(d: Draws) -> Column:
    return weighted(d.u8(0, 40), V.METHODS, total=100)


def protocol(d: Draws) -> Column:
    return pick(V.PROTOCOL_SLOTS, d.u8(0, 48).bitwiseAND(F.lit(3)))


def referrer(d: Draws) -> Column:
    slot = d.u8(0, 56)
    site = pick(V.REFERRERS, (slot - V.NO_REFERRER_SLOTS) % len(V.REFERRERS))
    return F.when(slot < V.NO_REFERRER_SLOTS, F.lit("-")).otherwise(site)


def log_level(d: Draws) -> Column:
    return weighted(d.u8(1, 24), V.LOG_LEVELS, total=100, rest=V.REST_LEVEL)


def service(d: Draws) -> Column:
    return pick(V.SERVICES, d.u8(1, 8).bitwiseAND(F.lit(7)))


def host(d: Draws) -> Column:
    return pick(V.HOSTS, d.u8(1, 16).bitwiseAND(F.lit(7)))


def username(d: Draws) -> Column:
    slot = d.u8(1, 0).bitwiseAND(F.lit(63))
    return F.when(slot < V.ANONYMOUS_SLOTS, F.lit("-")).otherwise(pick(V.USERNAMES, slot - V.ANONYMOUS_SLOTS))


# -- D11, D15, D17: numeric fields -----------------------------------------------------------
def _between(draw: Column, lo: int, hi: int) -> Column:
    return F.lit(lo) + draw % F.lit(hi - lo + 1)


def response_size(d: Draws, status: Column) -> Column:
    """Body bytes by status, ranges inclusive."""
    kind, draw = d.u8(2, 8), d.u32(2, 16)
    small, medium, large = _between(draw, 50, 500), _between(draw, 500, 5000), _between(draw, 5000, 50000)
    return (
        F.when(status == 204, F.lit(0))
        .when(status.isin(200, 201), F.when(kind < 100, small).when(kind < 200, medium).otherwise(large))
        .when(status.isin(301, 302, 304, 307), small)
        .when((status >= 400) & (status <= 599), _between(draw, 100, 1000))
        .otherwise(medium)
        .cast("bigint")
    )


def request_seconds(d: Draws, status: Column) -> Column:
    """Request time in seconds (FLOAT arithmetic): slower for errors."""
    u = d.unit(8, 0)

    def scaled(lo: float, span: float) -> Column:
        f = lambda x: F.lit(x).cast("float")
        return (f(lo) + (u * f(span)).cast("float")).cast("float")

    return F.when(status >= 500, scaled(0.5, 4.5)).when(status >= 400, scaled(0.01, 0.5)).otherwise(scaled(0.001, 0.2))


def duration_ms_for(d: Draws, status: Column) -> Column:
    draw = d.u32(3, 0)
    return (
        F.when(status >= 500, F.lit(100) + draw % F.lit(5000))
        .when(status >= 400, F.lit(10) + draw % F.lit(500))
        .otherwise(F.lit(1) + draw % F.lit(200))
        .cast("int")
    )


def syslog_duration(d: Draws) -> Column:
    return (F.lit(1) + d.below(7, 32, 999)).cast("int")


def request_size(d: Draws) -> Column:
    return (F.lit(100) + d.below(3, 32, 10000)).cast("int")


def process_id(d: Draws) -> Column:
    return (F.lit(1000) + d.below(7, 0, 50000)).cast("int")


# -- D16: hexadecimal ids --------------------------------------------------------------------
def trace_id(d: Draws) -> Column:
    return d.hex_digits(4, 0, 64)


def span_id(d: Draws) -> Column:
    return d.hex_digits(5, 0, 32)


def message_id(d: Draws) -> Column:
    return F.concat(F.lit("MSG"), F.upper(d.hex_digits(5, 32, 32)))


def request_id(d: Draws) -> Column:
    return d.hex_digits(6, 0, 64)


# -- D12, D13, D14: pool fields --------------------------------------------------------------
def ip_index(d: Draws) -> Column:
    return d.u16(0, 0)


def ip_entry(e: Draws) -> Column:
    """Address of one pool entry: private ranges 60 %, the rest drawn from 1-223.

    The rest avoids first octets 10 and 127 only, so it can land in other
    private ranges again; that is intended and shows in the distribution audit.
    """
    kind = e.below(0, 0, 100)
    b, c = e.u8(0, 32).cast("string"), e.u8(0, 40).cast("string")
    last = (e.below(0, 48, 254, width=16) + 1).cast("string")
    first = e.below(1, 0, 221) + 1
    first = F.when(first >= 126, first + 2).when(first >= 10, first + 1).otherwise(first)
    dot = F.lit(".")
    return (
        F.when(kind < 30, F.concat(F.lit("10."), b, dot, c, dot, last))
        .when(kind < 50, F.concat(F.lit("192.168."), c, dot, last))
        .when(kind < 60, F.concat(F.lit("172."), (e.u8(1, 32).bitwiseAND(F.lit(15)) + 16).cast("string"), dot, c, dot, last))
        .otherwise(F.concat(first.cast("string"), dot, b, dot, c, dot, last))
    )


def ip_address(d: Draws) -> Column:
    return ip_entry(d.substream("ip", ip_index(d)))


def path_index(d: Draws) -> Column:
    return d.u16(0, 16).bitwiseAND(F.lit(V.PATH_POOL_SIZE - 1))


def path_entry(e: Draws) -> Column:
    """URL path of one pool entry (prefix "/" gives a double slash)."""
    kind = e.below(0, 0, 100)
    prefix_no = e.u8(0, 32).bitwiseAND(F.lit(15))
    segment = pick(V.PATH_SEGMENTS, e.below(0, 40, len(V.PATH_SEGMENTS), width=16))
    page = F.concat(pick(V.PATH_PREFIXES, prefix_no), F.lit("/"), segment)
    numbered = F.concat(page, F.lit("/"), (e.below(1, 0, 99999) + 1).cast("string"))
    asset = F.concat(
        F.lit("/static/"), e.hex_digits(1, 32, 32), pick(V.PATH_EXTENSIONS, e.below(4, 0, len(V.PATH_EXTENSIONS), width=16))
    )
    uuid = F.concat_ws(
        "-", e.hex_digits(2, 0, 32), e.hex_digits(2, 32, 16), e.hex_digits(2, 48, 16), e.hex_digits(3, 0, 16), e.hex_digits(3, 16, 48)
    )
    resource = F.concat(F.lit("/api/v1/"), pick(V.PATH_RESOURCES, e.u16(4, 16).bitwiseAND(F.lit(3))), F.lit("/"), uuid)
    listing = F.concat(
        pick(V.PATH_PREFIXES, prefix_no.bitwiseAND(F.lit(7))),
        F.lit("/"),
        segment,
        F.lit("?page="),
        (e.below(4, 32, 99, width=16) + 1).cast("string"),
        F.lit("&limit="),
        pick(V.PAGE_LIMITS, e.below(4, 48, len(V.PAGE_LIMITS), width=8)).cast("string"),
    )
    return (
        F.when(kind < 40, F.when(e.coin(0, 56), numbered).otherwise(page))
        .when(kind < 60, asset)
        .when(kind < 75, resource)
        .when(kind < 90, listing)
        .otherwise(pick(V.SIMPLE_PATHS, e.u8(4, 56).bitwiseAND(F.lit(7))))
    )


def url_path(d: Draws) -> Column:
    return path_entry(d.substream("path", path_index(d)))


def agent_index(d: Draws) -> Column:
    return d.u8(0, 32)


def agent_entry(e: Draws) -> Column:
    """User agent of one pool entry: a family by its share, then one of its agents."""
    shares = [(number, share) for number, (share, _) in enumerate(V.USER_AGENT_FAMILIES)]
    family = weighted(e.below(0, 0, 100), shares, total=100, slots=100)
    sizes = [len(agents) for _, agents in V.USER_AGENT_FAMILIES]
    firsts = [sum(sizes[:n]) for n in range(len(sizes))]
    agents = [agent for _, group in V.USER_AGENT_FAMILIES for agent in group]
    return pick(agents, pick(firsts, family) + e.u32(0, 32) % pick(sizes, family))


def user_agent(d: Draws) -> Column:
    return agent_entry(d.substream("agent", agent_index(d)))


# -- pools as tables -------------------------------------------------------------------------
# A row's pool field is a function of a small index, so the pool can be computed
# once and broadcast; its size is fixed, whatever the size of the data.
POOLS = {
    "ip": (V.IP_POOL_SIZE, ip_index, ip_entry, 2),
    "path": (V.PATH_POOL_SIZE, path_index, path_entry, 5),
    "user_agent": (V.UA_POOL_SIZE, agent_index, agent_entry, 1),
}
POOL_STREAMS = {"user_agent": "agent"}


def with_pool_field(df: DataFrame, d: Draws, name: str, where: Column | None = None) -> DataFrame:
    """Add ``_pool_<name>`` by a broadcast lookup: same values as the inline expression, NULL where ``where`` is not met."""
    size, index, entry, n_words = POOLS[name]
    slot = f"_slot_{name}"
    slots = df.sparkSession.range(0, size, 1, 4).withColumnRenamed("id", slot)
    pool, e = d.substream(POOL_STREAMS.get(name, name), F.col(slot)).materialize(slots, n_words)
    pool = pool.select(slot, entry(e).alias(f"_pool_{name}"))
    at = index(d) if where is None else F.when(where, index(d))
    return df.withColumn(slot, at).join(F.broadcast(pool), slot, "left").drop(slot)
