"""A whole run: scripts to planned rows, state, fields, lines, totals and payloads.

The single steps are S19, R5, S18, R6, F6, M7 and K4-K7; here they follow each
other without a step that moves the rows, up to the packing: rows are made
where their block of the budget lies, find their state among the few of their
bucket (or by a merge, where scripts are long), and only the packed text is
shuffled, once.  A run of requests does not shuffle its text either: planned
buckets are dealt by the group that packs their rows, before these are made.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.requests import expand_requests
from ..sources.rows import generate_rows, with_log_fields
from .attach import States, attach_scenario
from .budget import row_budget
from .control import Control
from .formats import DEFAULT_FORMAT, FORMAT_FIELDS, format_names, format_ok, render
from .metrics import by_state, is_error_line
from .payloads import DEFAULT_LIMIT, body_of
from .timeline import timeline_segments

#: Key of a row of a run: equal keys draw equal fields.
RUN_KEYS = ["scenario_id", "bucket", "i"]
BUCKET_MS = 1_000
BLOCK_ROWS = 65_536
#: Rows that a task of dealt groups should make and pack, and those of a group beyond which its text is shuffled instead.
TASK_ROWS, GROUP_ROWS, MOST_TASKS = 1 << 17, 1 << 18, 10_000
#: Columns that say where a row of dealt groups lies: no deal (below 0), or the bucket of a group that is too large for one task.
DEALT = ["scenario_id", "_window", "_deal", "_block"]


def run_rows(
    control: Control,
    origin: str,
    seed: int = 0,
    digest: str = "xxhash64",
    bucket_ms: int = BUCKET_MS,
    states: States | None = None,
    outputs: DataFrame | None = None,
    formats: Sequence[str] | None = None,
) -> DataFrame:
    """Every row that the scripts plan, rendered in the format of its scenario.

    The number of rows is exactly that of :func:`row_budget`.  Fields are drawn
    at the error rate that the scenario has at the row's own time.  ``outputs``
    (``scenario_id, format, batch_bytes``) overrides the scripts' formats and
    adds the batch limit; a scenario without a format gets the default one, and
    one without an output row makes no rows.  ``formats`` limits the formats
    that may occur; any other one is an error, found before the run.
    Columns: the key, ``t_ms``, ``ts``, the state, ``fmt``, ``line``,
    ``n_bytes``, ``is_error`` (by what the line shows) and the drawn fields.
    """
    plan, allowed = _planned(control, bucket_ms, control.meta if outputs is None else outputs, formats, () if outputs is None else ("batch_bytes",))
    return _rows(plan, States.of(control, seed, digest) if states is None else states, origin, seed, digest, bucket_ms, allowed)


def _planned(
    control: Control, bucket_ms: int, source: DataFrame, formats: Sequence[str] | None = None, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Rows per bucket of the scenarios of ``source``, with their format and ``keep``, and the formats that may occur."""
    allowed = list(formats or format_names())
    asked = source.select("scenario_id", F.coalesce(F.col("format"), F.lit(DEFAULT_FORMAT)).alias("fmt"), *keep)
    unknown = asked.filter(~format_ok("fmt") | ~F.col("fmt").isin(*allowed)).select("fmt").first()
    if unknown:
        raise ValueError(f"unknown format {unknown['fmt']!r}, use one of {allowed}")
    longest = control.meta.agg(F.max("total_ms")).first()[0] or 0
    plan = row_budget(timeline_segments(control), bucket_ms, longest_ms=longest)
    return plan.select("scenario_id", "bucket", "n_rows").join(asked, "scenario_id"), allowed


def _rows(
    plan: DataFrame, states: States, origin: str, seed: int, digest: str, bucket_ms: int, allowed: Sequence[str], parts: int | None = None
) -> DataFrame:
    """The rendered rows of a plan; with ``parts`` they lie by :data:`DEALT`, in so many partitions."""
    keep = [c for c in plan.columns if c not in ("scenario_id", "bucket", "n_rows")]
    plan, held = states.in_buckets(plan, bucket_ms)
    if parts is None:
        rows = generate_rows(plan, bucket_ms, origin, keep=keep + held)
    else:
        rows = generate_rows(plan, bucket_ms, origin, BLOCK_ROWS, keep + held, DEALT[:-1], parts, DEALT[-1])
    rows = attach_scenario(rows, states, "ts", origin, "scenario_id")
    shown = list(dict.fromkeys(f for name in allowed for f in FORMAT_FIELDS[name]))
    needed = list(dict.fromkeys([*shown, "status", "syslog_level"]))
    # A line draws what its format reads; the whole fields cost nothing where nobody takes them.
    rate = F.col("error_rate")
    rows = with_log_fields(rows, RUN_KEYS, "ts", seed, digest, rate, "_own_", needed, fmt=F.col("fmt"), formats=allowed)
    own = [f"_own_{f}" for f in needed]
    rows = render(rows, F.col("fmt"), prefix="_own_", formats=allowed)
    rows = rows.withColumn("is_error", is_error_line("fmt", "_own_status", "_own_syslog_level")).drop(*own)
    return with_log_fields(rows, RUN_KEYS, "ts", seed, digest, rate, fields=needed, pools="inline")


def run_totals(rows: DataFrame, cols: Sequence[str] = ("fmt", "spike_active")) -> DataFrame:
    """Rows, bytes and errors of a run per format and state, or any other columns."""
    return by_state(rows, cols, F.col("is_error"))


def run_payloads(rows: DataFrame, limit_bytes: int | Column = DEFAULT_LIMIT, window_buckets: int = 1, block: int = BLOCK_ROWS) -> DataFrame:
    """Payloads of the rows of a run, reproducible, with one exchange of their text.

    A payload holds lines of one scenario, of ``window_buckets`` buckets in a row
    and of at most ``block`` rows of each of them, so a group holds at most
    ``window_buckets * block`` rows however fast the scenario is; slow
    scenarios want a longer window.  Within a group the running byte count, cut
    on a fixed grid, numbers the batches (a line belongs to the batch its first
    byte falls into).  ``limit_bytes`` may be a column, one value a scenario.
    """
    limit = F.lit(limit_bytes) if isinstance(limit_bytes, int) else limit_bytes
    group = {"_window": F.floor(F.col("bucket") / F.lit(window_buckets)), "_block": F.floor(F.col("i") / F.lit(block))}
    return _pack(rows.withColumns(group), ["scenario_id", *group], limit)


def _pack(rows: DataFrame, group: Sequence[str], limit: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Payloads of every ``group`` of rows; ``keep`` names columns that have one value a scenario."""
    rows = rows.select(*group, "bucket", "i", "fmt", "line", (F.octet_length("line") + 1).cast("bigint").alias("_size"), limit.cast("bigint").alias("_limit"), *keep)
    so_far = Window.partitionBy(*group).orderBy("bucket", "i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_batch", F.floor((F.sum("_size").over(so_far) - F.col("_size")) / F.col("_limit")))
    packed = rows.groupBy(*group, "_batch", "fmt").agg(
        F.count("*").alias("n_rows"), F.sort_array(F.collect_list(F.struct("bucket", "i", "line"))).alias("_rows"), *[F.any_value(c).alias(c) for c in keep]
    )
    number = [F.col(c).cast("string") for c in ("scenario_id", "_window", "_block", "_batch")]
    body = body_of(F.transform("_rows", lambda r: r["line"]), F.col("fmt"))
    packed = packed.select(F.concat_ws("-", *number).alias("payload_id"), "scenario_id", "fmt", "n_rows", body.alias("body"), *keep)
    return packed.withColumn("n_bytes", F.octet_length("body").cast("bigint"))


def _dealt(plan: DataFrame, window_buckets: int, block: int = BLOCK_ROWS) -> DataFrame:
    """The plan with the group that packs each bucket, and whether its rows are too many for one task."""
    plan = plan.filter("n_rows > 0").withColumn("_window", F.floor(F.col("bucket") / F.lit(window_buckets)))
    # The first block of a window holds the most rows.
    most = F.sum(F.least("n_rows", F.lit(block))).over(Window.partitionBy("scenario_id", "_window"))
    return plan.withColumn("_deal", F.when(most > GROUP_ROWS, F.col("bucket")).otherwise(F.lit(-1)).cast("bigint"))


def run_requests(
    requests: DataFrame,
    json_col: str,
    id_col: str,
    origin: str,
    seed: int = 0,
    digest: str = "xxhash64",
    bucket_ms: int = BUCKET_MS,
    aliases: Mapping[str, str] | None = None,
    window_buckets: int = 1,
) -> dict[str, DataFrame]:
    """Run every accepted request: its rows, and payloads at its own batch limit.

    Gives ``rows``, ``payloads`` (with ``url``), ``outputs`` and ``rejected``.
    The control tables are written once and read back, so that no step parses
    the requests again.  So is the plan, whose buckets are dealt by the group
    that packs their rows (see :func:`run_payloads`): text is made where it is
    packed, and not shuffled.  Only that of groups of more than ``GROUP_ROWS``
    rows is, as one task should not make them all.  The URL travels with the
    plan; where an id has several outputs, each of them joins all its payloads.
    """
    got = expand_requests(requests, json_col, id_col, aliases)
    tables = {name: getattr(got["control"], name) for name in ("meta", "timeline", "spikes", "rates")}
    control = Control(**{name: None if t is None else written(t, name) for name, t in tables.items()})
    outputs = got["outputs"]
    targets = F.count("*").over(Window.partitionBy("scenario_id")).alias("_targets")
    named = outputs.filter("scenario_id is not null").select("scenario_id", "format", "batch_bytes", "url", targets)
    plan, allowed = _planned(control, bucket_ms, named, keep=("batch_bytes", "url", "_targets"))
    plan = written(_dealt(plan, window_buckets), "plan")
    size = plan.agg(F.sum(F.col("n_rows").cast("double")).alias("rows"), F.max("_targets").alias("targets"), F.max("_deal").alias("deal")).first()
    total, single, split = int(size["rows"] or 0), (size["targets"] or 0) <= 1, size["deal"] is not None and size["deal"] >= 0
    slots = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(total // TASK_ROWS + 1, min(slots, total // 4096 + 1)), MOST_TASKS)
    rows = _rows(plan.drop("_targets"), States.of(control, seed, digest), origin, seed, digest, bucket_ms, allowed, parts)
    limit, keep = F.col("batch_bytes"), ["url"] if single else []
    if split:
        whole = _pack(rows.filter("_deal < 0"), DEALT, limit, keep)
        packed = whole.unionByName(_pack(rows.filter("_deal >= 0"), [c for c in DEALT if c != "_deal"], limit, keep))
    else:
        packed = _pack(rows, DEALT, limit, keep)
    if not single:
        packed = packed.join(outputs.select("scenario_id", "url"), "scenario_id")
    return {
        "rows": rows.drop("url", *DEALT[1:]), "payloads": packed.select("scenario_id", "payload_id", "fmt", "n_rows", "body", "n_bytes", "url"),
        "outputs": outputs, "rejected": got["rejected"],
    }
