"""Lines to size-bounded payloads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spikes import repeat_numbers

# Default batch size in bytes; body shape and content type by format.
DEFAULT_LIMIT = 1024 * 1024
BODY_SHAPES = {
    "raw": ("", "\n", "\n"),
    "array": ("[", ",", "]"),
    "envelope": ('{"events":[', ",", "]}"),
}
PAYLOAD_SCHEMA = "payload_id string, fmt string, n_rows bigint, n_bytes bigint, body string"


def batch_format(fmt: Column) -> Column:
    """Body shape by log format: events in an envelope, JSON records in an array, text as lines."""
    return F.when(fmt == "event", F.lit("envelope")).when(fmt == "json", F.lit("array")).otherwise(F.lit("raw"))


def content_type(fmt: Column) -> Column:
    return F.when(fmt.isin("event", "json"), F.lit("application/json")).otherwise(F.lit("application/x-ndjson"))


def body_of(lines: Column, fmt: Column) -> Column:
    """Payload text of an array of lines."""
    shape, out = batch_format(fmt), None
    for name, (head, sep, tail) in BODY_SHAPES.items():
        text = F.concat(F.lit(head), F.array_join(lines, sep), F.lit(tail))
        out = F.when(shape == name, text) if out is None else out.when(shape == name, text)
    return out


def bucket_of(keys: Sequence[str | Column], buckets: int) -> Column:
    """Bucket from the leading 32 bits of an MD5 over the key columns."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def packable(df: DataFrame, fmt_col: str = "fmt") -> tuple[DataFrame, DataFrame]:
    """Rows that can be packed, and those that cannot: a NULL line or format.  The packers refuse the latter."""
    ok = F.col(fmt_col).isNotNull() & F.col("line").isNotNull()
    return df.filter(ok), df.filter(~ok)


def _refuse_nulls(df: DataFrame, fmt_col: str) -> DataFrame:
    message = F.lit("a row without line or format cannot be packed: see packable()")
    present = lambda c: F.when(F.col(c).isNull(), F.raise_error(message).cast("string")).otherwise(F.col(c))
    return df.withColumns({c: present(c) for c in (fmt_col, "line")})


def pack_keyed(
    df: DataFrame,
    order_cols: Sequence[str],
    buckets: int,
    limit_bytes: int = DEFAULT_LIMIT,
    fmt_col: str = "fmt",
) -> DataFrame:
    """Deterministic payloads: the same rows give the same payloads under any partitioning.

    Rows are hashed into buckets by their whole key and line; within a bucket
    the running byte count, cut on a fixed grid of ``limit_bytes``, numbers the
    batches (a line belongs to the batch its first byte falls into).  Copies of
    one row are counted before the shuffle and dealt out by arithmetic, and
    batches are dealt over the cluster before their text is built, so a group
    of equal rows never travels, sorts or expands in one task.  Choose
    ``buckets`` so that one bucket fits a task.
    """
    keys = list(order_cols)
    rows = _refuse_nulls(df, fmt_col).groupBy(fmt_col, *keys, "line").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("_size", (F.octet_length("line") + 1).cast("bigint"))
    rows = rows.withColumn("_bucket", bucket_of([fmt_col, *keys, "line"], buckets))
    order = Window.partitionBy(fmt_col, "_bucket").orderBy(*keys, "line").rowsBetween(Window.unboundedPreceding, 0)
    size, copies, limit = F.col("_size"), F.col("copies"), F.lit(limit_bytes)
    rows = rows.withColumn("_start", F.sum(size * copies).over(order) - size * copies)
    first, last = F.floor(F.col("_start") / limit), F.floor((F.col("_start") + (copies - 1) * size) / limit)
    rows = repeat_numbers(rows, last - first + 1, "_k").withColumn("_batch", first + F.col("_k"))
    # Copies whose first byte lies in this batch.
    before = lambda b: F.least(F.greatest(F.ceil((b * limit - F.col("_start")) / size), F.lit(0)), copies)
    rows = rows.withColumn("_n", (before(F.col("_batch") + 1) - before(F.col("_batch"))).cast("int"))
    entry = F.struct(*keys, "line", "_n")
    rows = rows.filter("_n > 0").select(fmt_col, "_bucket", "_batch", "_n", entry.alias("_row"))
    groups = rows.repartition(fmt_col, "_bucket", "_batch").groupBy(fmt_col, "_bucket", "_batch").agg(
        F.sum("_n").cast("bigint").alias("n_rows"), F.sort_array(F.collect_list("_row")).alias("_rows")
    )
    lines = F.flatten(F.transform("_rows", lambda r: F.array_repeat(r["line"], r["_n"])))
    out = groups.select(
        F.concat_ws("-", fmt_col, F.col("_bucket").cast("string"), F.col("_batch").cast("string")).alias("payload_id"),
        F.col(fmt_col).alias("fmt"),
        "n_rows",
        body_of(lines, F.col(fmt_col)).alias("body"),
    )
    return out.withColumn("n_bytes", F.octet_length("body").cast("bigint")).select(
        "payload_id", "fmt", "n_rows", "n_bytes", "body"
    )


def pack_partitions(df: DataFrame, limit_bytes: int = DEFAULT_LIMIT, fmt_col: str = "fmt") -> DataFrame:
    """Payloads per input partition, in row order, without any shuffle.

    The closing rule is the greedy one: a batch closes once its bytes reach the
    limit, the last one is flushed.  Memory is one open batch per format.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        open_: dict[str, pa.Array] = {}
        counter: dict[str, int] = {}

        def emit(fmt: str, lines: pa.Array, starts: list[int]) -> pa.RecordBatch:
            head, sep, tail = BODY_SHAPES[{"event": "envelope", "json": "array"}.get(fmt, "raw")]
            groups = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), lines.cast(pa.large_string()))
            text = lambda x: pa.scalar(x, pa.large_string())
            joined = pc.binary_join(groups, text(sep))
            body = pc.binary_join_element_wise(text(head), joined, text(tail), text(""))
            n = len(body)
            base = counter.get(fmt, 0)
            counter[fmt] = base + n
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{fmt}-{task}-{base + i}" for i in range(n)]),
                    pa.array([fmt] * n),
                    pa.array(np.diff(starts), pa.int64()),
                    pc.binary_length(body).cast(pa.int64()),
                    body.cast(pa.string()),
                ],
                names=["payload_id", "fmt", "n_rows", "n_bytes", "body"],
            )

        for batch in batches:
            fmts = batch.column(0)
            for fmt in pc.unique(fmts).to_pylist():
                lines = batch.column(1).filter(pc.equal(fmts, fmt))
                if fmt in open_:
                    lines = pa.concat_arrays([open_.pop(fmt), lines])
                ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
                starts, base = [0], 0
                while True:
                    cut = int(np.searchsorted(ends, base + limit_bytes))
                    if cut >= len(ends):
                        break
                    starts.append(cut + 1)
                    base = int(ends[cut])
                if len(starts) > 1:
                    yield emit(fmt, lines.slice(0, starts[-1]), starts)
                if starts[-1] < len(lines):
                    # Copy the open rest, so the batch it came from can be freed.
                    open_[fmt] = pa.concat_arrays([lines.slice(starts[-1])])
        for fmt, lines in open_.items():
            yield emit(fmt, lines, [0, len(lines)])

    return _refuse_nulls(df, fmt_col).select(F.col(fmt_col).alias("fmt"), "line").mapInArrow(pack, PAYLOAD_SCHEMA)


def pack_payloads(
    df: DataFrame,
    fmt: str | None = None,
    limit_bytes: int = DEFAULT_LIMIT,
    order_cols: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Payloads of rendered rows; keyed (reproducible) when ``order_cols`` is given.

    Without ``buckets`` the keyed form counts bytes once and aims at 64 batches
    per bucket.
    """
    rows = df.withColumn("fmt", F.lit(fmt)) if fmt is not None else df
    if not order_cols:
        return pack_partitions(rows, limit_bytes)
    if buckets is None:
        total = rows.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
        buckets = total // (64 * limit_bytes) + 1
    return pack_keyed(rows, order_cols, buckets, limit_bytes)
