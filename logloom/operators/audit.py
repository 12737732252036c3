"""Ground truth, detector scoring and distribution audits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import vocab as V
from ..functions.draws import Draws, slot_counts
from .attach import TIME_BLOCKS
from .scan import Scan
from .spikes import repeat_numbers


def ground_truth(attached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anomaly labels per row of an attached table (G1)."""
    return attached.select(
        *keys,
        "t_ms",
        F.col("spike_active").alias("is_anomaly"),
        (F.col("spike_error") > F.col("base_error")).alias("is_error_burst"),
        (F.col("latency_multiplier") > 0).alias("is_latency"),
        F.col("unusual").alias("is_unusual"),
    )


def truth_buckets(instances: DataFrame, meta: DataFrame, bucket_ms: int, span: int = 1 << 16, longest_ms: int | None = None) -> DataFrame:
    """Labels of every bucket of every clock, also of those without rows (G1).

    Per (scenario_id, bucket): ``started`` spikes, ``spike_ms`` (active time, overlapping spikes each),
    ``anomalous_ms`` (time with any active spike) and ``is_anomaly`` (more than half of the bucket).
    Spikes enter as their two edges, clocks as a mark at 0 that holds their end.  Running sums of the marks'
    signs and times give the active time up to the end of each bucket that has a mark; it then makes the
    buckets up to the next one with a mark.  Buckets are made once, at the end: none is shuffled, sorted or
    joined.  One count decides: where no scenario has more than ``span`` marks, all sums follow one shuffle of
    marks, else they run in blocks.  Buckets are dealt over the cluster in blocks before they are made, unless
    ``longest_ms``, the longest clock, has at most ``span`` of them.
    """
    most = instances.groupBy("scenario_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    one_block = 2 * most + 1 <= span
    # Blocks of ``span`` buckets could hold any number of edges: the longest clock has many blocks.
    block_ms = span * bucket_ms if longest_ms is None else max(1, longest_ms // TIME_BLOCKS)
    big = lambda c: c.cast("bigint")
    edge = lambda at, sign: F.struct(big(at).alias("ms"), big(F.lit(sign)).alias("sign"), big(F.lit(None)).alias("total_ms"))
    start, end = F.greatest("start_ms", F.lit(0)), F.col("end_ms")
    # Tested where edges are made: a filter on the times would draw the jitter again for each use of them.
    both = F.when(end.isNull(), F.array(edge(start, 1))).when(start < end, F.array(edge(start, 1), edge(end, -1)))
    marks = instances.where("scenario_id is not null").select("scenario_id", F.inline(both))
    marks = marks.unionByName(meta.select("scenario_id", big(F.lit(0)).alias("ms"), big(F.lit(0)).alias("sign"), big(F.col("total_ms")).alias("total_ms")))
    if one_block:
        marks = marks.repartition("scenario_id")
    edges = marks.groupBy("scenario_id", "ms").agg(F.sum("sign").alias("sign"), F.sum(big(F.col("sign") > 0)).alias("started"), F.max("total_ms").alias("_total"))
    scan = Scan(["scenario_id"], "ms", None if one_block else block_ms)
    edges = scan.apply(edges, running={"_on": ("sum", F.col("sign")), "total_ms": ("last", F.col("_total"))}).where("ms < total_ms")
    # Where any spike begins to be active, or none is any more.
    any_sign = big(F.col("_on") > 0) - big(F.col("_on") > F.col("sign"))
    bucket = F.floor(F.col("ms") / F.lit(bucket_ms)).alias("bucket")
    sums = {"sign": F.col("sign"), "moment": F.col("sign") * F.col("ms"), "any": any_sign, "any_moment": any_sign * F.col("ms"), "started": F.col("started")}
    parts = edges.groupBy("scenario_id", bucket).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.max("total_ms").alias("total_ms"))
    running = {f"_{n}": ("sum", F.col(n)) for n in sums if n != "started"}
    parts = Scan(["scenario_id"], "bucket", None if one_block else span).apply(parts, running=running, following={"_next": F.col("bucket")})
    count = F.ceil(F.col("total_ms") / F.lit(bucket_ms))
    few = longest_ms is not None and longest_ms <= span * bucket_ms
    cells = repeat_numbers(parts, F.least("_next", count) - F.col("bucket"), "_after", spread_by=None if few else ["scenario_id", "bucket"])
    own = {n: big(F.when(F.col("_after") == 0, F.col(n)).otherwise(F.lit(0))) for n in sums}
    cells = cells.withColumns({**own, "bucket": F.col("bucket") + F.col("_after")})
    end = F.least((F.col("bucket") + 1) * F.lit(bucket_ms), "total_ms")
    # Up to a time t the active time is the sum of sign * (t - edge); the part before the bucket is taken off.
    begin = F.col("bucket") * F.lit(bucket_ms)

    def within(sign: str, moment: str) -> Column:
        upto = F.col(f"_{sign}") * end - F.col(f"_{moment}")
        earlier = (F.col(f"_{sign}") - F.col(sign)) * begin - (F.col(f"_{moment}") - F.col(moment))
        return (upto - earlier).cast("bigint")

    out = cells.withColumns({"spike_ms": within("sign", "moment"), "anomalous_ms": within("any", "any_moment")})
    return out.select("scenario_id", "bucket", "started", "spike_ms", "anomalous_ms", (F.col("anomalous_ms") * 2 > end - begin).alias("is_anomaly"))


def score_alerts(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion counts, precision and recall of bucket alerts.

    Both sides have one row per bucket: ``alerts`` (key columns, ``alert``) and
    ``truth`` (key columns, ``anomalous``); a full outer equi-join pairs them.
    """
    keys = [c for c in truth.columns if c != "anomalous"]
    both = alerts.join(truth, keys, "full_outer").select(
        F.coalesce("alert", F.lit(False)).alias("a"), F.coalesce("anomalous", F.lit(False)).alias("t")
    )
    count = lambda cond, name: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0)).alias(name)
    out = both.agg(
        count(F.col("a") & F.col("t"), "tp"),
        count(F.col("a") & ~F.col("t"), "fp"),
        count(~F.col("a") & F.col("t"), "fn"),
        count(~F.col("a") & ~F.col("t"), "tn"),
    )
    share = lambda part, rest: F.when(F.col(part) + F.col(rest) > 0, F.col(part) / (F.col(part) + F.col(rest)))
    return out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def detection_delay(alerts: DataFrame, instances: DataFrame, bucket_ms: int, span: int = 1 << 16) -> DataFrame:
    """First alert inside each spike instance and its delay; NULL when missed.

    ``alerts`` has one row per alerting ``(scenario_id, bucket)``.  Alerts and
    spike starts are merged in falling time order, and a spike takes the last
    alert before it in that order: the next one in time.  Whether it still lies
    in the spike decides.  Work is linear in alerts plus spikes, however long
    the spikes are; it runs in blocks of ``span`` places of the order.
    """
    b = F.lit(bucket_ms)
    first, last = F.floor(F.col("start_ms") / b), F.floor((F.col("end_ms") - 1) / b)
    keys = ["scenario_id", "spike_idx", "rep"]
    # Falling order; an alert comes before the spikes that start in its bucket.
    spikes = instances.filter("end_ms > start_ms").select("scenario_id", (1 - first * 2).alias("_at"), F.struct(*keys, "type", "start_ms", last.alias("last")).alias("_spike"), F.lit(None).cast("bigint").alias("_alert"))
    marks = alerts.select("scenario_id", (F.col("bucket") * -2).cast("bigint").alias("_at"), F.lit(None).cast(spikes.schema["_spike"].dataType).alias("_spike"), F.col("bucket").cast("bigint").alias("_alert"))
    met = Scan(["scenario_id"], "_at", span).apply(spikes.unionAll(marks), running={"_next": ("last", F.col("_alert"))})
    found = met.where(F.col("_spike").isNotNull()).select("_spike.*", F.when(F.col("_next") <= F.col("_spike.last"), F.col("_next")).alias("first_bucket")).drop("last")
    return found.withColumns(
        {
            "detected": F.col("first_bucket").isNotNull(),
            "delay_ms": F.greatest(F.col("first_bucket") * b - F.col("start_ms"), F.lit(0)),
        }
    )


# -- G3 --------------------------------------------------------------------------------------
STATUS_CODES = {"success_status": V.SUCCESS_CODES, "client_status": V.CLIENT_ERROR_CODES, "server_status": V.SERVER_ERROR_CODES}
#: Fields of :func:`audit_fields`: drawn by slots, and drawn through a pool.
SLOT_FIELDS = ["method", "level", "protocol", "service", "host", "referrer", "username", *STATUS_CODES]
POOL_FIELDS = ["address_class", "path_class", "user_agent"]


def expected_shares(field: str) -> list[tuple[str, float]]:
    """Expected share per value of a drawn field."""
    if field == "method":
        runs = slot_counts(V.METHODS, total=100)
    elif field == "level":
        runs = slot_counts(V.LOG_LEVELS, total=100, rest=V.REST_LEVEL)
    elif field == "protocol":
        runs = [(p, 64) for p in V.PROTOCOL_SLOTS]
    elif field == "service":
        runs = [(s, 32) for s in V.SERVICES]
    elif field == "host":
        runs = [(h, 32) for h in V.HOSTS]
    elif field == "referrer":
        sites = [V.REFERRERS[i % len(V.REFERRERS)] for i in range(256 - V.NO_REFERRER_SLOTS)]
        runs = [("-", V.NO_REFERRER_SLOTS)] + [(s, 1) for s in sites]
    elif field == "username":
        runs = [("-", 4 * V.ANONYMOUS_SLOTS)] + [(name, 4) for name in V.USERNAMES]
    elif field in STATUS_CODES:
        runs = [(str(c), n) for c, n in slot_counts(STATUS_CODES[field])]
    else:
        raise ValueError(f"no expected distribution for {field!r}")
    shares: dict[str, float] = {}
    for value, n in runs:
        shares[value] = shares.get(value, 0) + n / 256.0
    return list(shares.items())


def audit_distribution(df: DataFrame, field: str, value: Column | None = None) -> DataFrame:
    """Observed against expected share per value with its chi-square term.

    Every expected value has a row, also one that never occurs.  Counting is
    partial before the shuffle and the only pass over the rows.  Values outside
    the list get expected share 0 and no term.
    """
    shares = expected_shares(field)
    value = F.col(field) if value is None else value
    none = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(0).cast("bigint").alias("n")) for v, _ in shares])
    empty = df.sparkSession.range(1).select(F.inline(none))
    counts = df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(empty).groupBy("value").agg(F.sum("n").alias("observed"))
    total = counts.agg(F.sum("observed").alias("_total")).withColumn("_one", F.lit(1))
    share = None
    for v, s in shares:
        share = F.when(F.col("value") == v, F.lit(s)) if share is None else share.when(F.col("value") == v, F.lit(s))
    out = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")  # one row
    out = out.withColumn("expected", share.otherwise(F.lit(0.0)) * F.col("_total").cast("double")).drop("_total")
    gap = F.col("observed") - F.col("expected")
    return out.withColumn("chi2_term", F.when(F.col("expected") > 0, gap * gap / F.col("expected")))


def address_class(ip: Column) -> Column:
    """Private range of an address, or ``public``."""
    return (
        F.when(ip.startswith("10."), F.lit("10/8")).when(ip.startswith("192.168."), F.lit("192.168/16"))
        .when(ip.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.lit("172.16/12")).when(ip.isNotNull(), F.lit("public"))
    )


def path_class(path: Column) -> Column:
    """Kind of a path by its text."""
    return (
        F.when(path.rlike(r"^/static/[0-9a-f]{8}\."), F.lit("asset")).when(path.rlike(r"^/api/v1/[a-z]+/[0-9a-f]{8}-"), F.lit("resource"))
        .when(path.contains("?page="), F.lit("listing")).when(path.isin(*V.SIMPLE_PATHS), F.lit("simple")).when(path.isNotNull(), F.lit("page"))
    )


def audited(status: Column) -> dict[str, Column]:
    """Values of all audited fields of rows with the log fields; a code counts for its own class only."""
    drawn = {name: F.col(name) for name in SLOT_FIELDS if name not in STATUS_CODES}
    code = {"success_status": status < 400, "client_status": (status >= 400) & (status < 500), "server_status": status >= 500}
    pooled = {"address_class": address_class(F.col("ip")), "path_class": path_class(F.col("path")), "user_agent": F.col("user_agent")}
    return drawn | {name: F.when(inside, status) for name, inside in code.items()} | pooled


def pool_shares(df: DataFrame, seed: int, digest: str) -> DataFrame:
    """``field, value, share`` of the pools of a seed: a pool is drawn once, so its own shares are what rows should show."""
    out = None
    for field, (stream, size, entry, kind) in {
        "address_class": ("ip", V.IP_POOL_SIZE, X.ip_entry, address_class),
        "path_class": ("path", V.PATH_POOL_SIZE, X.path_entry, path_class),
        "user_agent": ("agent", V.UA_POOL_SIZE, X.agent_entry, lambda c: c),
    }.items():
        texts = df.sparkSession.range(0, size, 1, 4).select(entry(Draws(["id"], seed, digest, stream)).alias("text"))
        part = texts.groupBy(F.lit(field).alias("field"), kind(F.col("text")).alias("value")).agg((F.count("*") / F.lit(float(size))).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


def chi2_tail(x: Column, dof: Column, most: int = 255) -> Column:
    """Probability that a chi-square value with ``dof`` (1 to ``most``) degrees of freedom exceeds ``x``.

    One minus the series of the lower incomplete gamma function; beyond 1,400 the tail counts as 0.
    """
    a, y = dof / F.lit(2.0), x / F.lit(2.0)
    log_gamma = F.get(F.array(*[F.lit(math.lgamma(k / 2 + 1)) for k in range(most + 1)]), dof.cast("int"))
    pair = lambda term, total: F.struct(term.alias("term"), total.alias("total"))
    first = F.exp(a * F.log(y) - y - log_gamma)
    step = lambda s, n: pair(s["term"] * y / (a + n), s["total"] + s["term"] * y / (a + n))
    lower = F.aggregate(F.sequence(F.lit(1), F.lit(1500)), pair(first, first), step)["total"]
    return F.when(x <= 0, F.lit(1.0)).when(x > 1400, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - lower))


def audit_fields(df: DataFrame, fields: Mapping[str, Column], seed: int = 0, digest: str = "xxhash64") -> DataFrame:
    """All fields against their expected shares in one pass over the rows.

    One row per field and value, expected or met: ``observed``, ``expected``,
    ``chi2_term``, and of its field ``chi2``, ``dof`` and ``p_value``.  NULL
    values are not counted.  A value that no share expects has no term and makes
    the field's ``p_value`` 0; a field without rows has ``p_value`` 1.  Rows
    become one pair a field and are counted before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), value.cast("string").alias("value")) for name, value in fields.items()])
    counts = df.select(F.inline(pairs)).filter("value is not null").groupBy("field", "value").agg(F.count("*").alias("observed"))
    given = [(f, v, s) for f in fields if f not in POOL_FIELDS for v, s in expected_shares(f)]
    shares = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(s).alias("share")) for f, v, s in given])
    shares = df.sparkSession.range(1).select(F.inline(shares)) if given else None
    pooled = [f for f in fields if f in POOL_FIELDS]
    if pooled:
        drawn = pool_shares(df, seed, digest).filter(F.col("field").isin(*pooled))
        shares = drawn if shares is None else shares.unionByName(drawn)
    # From here on there is one row a field and value.
    out = counts.join(shares, ["field", "value"], "full").fillna(0, ["observed", "share"])
    field = Window.partitionBy("field")
    out = out.withColumn("expected", F.col("share") * F.sum("observed").over(field))
    gap = F.col("observed") - F.col("expected")
    out = out.withColumn("chi2_term", F.when(F.col("expected") > 0, gap * gap / F.col("expected")))
    known = F.col("share") > 0
    out = out.withColumns({
        "chi2": F.coalesce(F.sum("chi2_term").over(field), F.lit(0.0)), "dof": F.sum(known.cast("bigint")).over(field) - 1,
        "_odd": F.max((~known & (F.col("observed") > 0)).cast("int")).over(field),
    })
    p = F.when(F.col("_odd") == 1, F.lit(0.0)).otherwise(chi2_tail(F.col("chi2"), F.col("dof")))
    return out.withColumn("p_value", p).drop("share", "_odd")
