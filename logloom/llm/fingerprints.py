"""Document fingerprints: one-permutation MinHash, optimal densification, packed low bits.

Each five-word shingle is hashed once; the top byte of the hash is its bin and the smallest hash
of a bin its value.  An empty bin borrows from a full bin that its own probe order names: a few
fixed probes first, and for what is then still empty the full bin that comes first in the bin's
complete random order, so the choice always ends and depends on the set of full bins alone.  Four
low bits of each bin are kept (256 bins, 1,024 bits) and likeness is corrected for chance matches.

Defined cases: null reads as empty; a text of fewer than five words has one shingle, the whole
sequence; without a word it has none, and all such texts share one constant fingerprint.  Words
are split at ASCII white space and lower-cased.  Rows that repeat a ``doc_id`` are ordered by text;
rows with a null ``doc_id`` come before all others.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, blank

SHINGLE, BINS, BITS, PROBES = 5, 256, 4, 6
#: Documents that share a block of the id order; a block is one group of the neighbour window.
BLOCK_DOCS = 1000
#: Cells of about equally many rows that the id order is cut into first, so that ids may lie in clusters.
CELLS = 64


def word_hashes(text: Column) -> Column:
    """xxhash64 of each lower-cased word."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<bigint>, 4 bits a bin, 16 bins a word; all bits set for a text without words."""
    steps = [f"_{out}{i}" for i in range(4 + PROBES)]
    df = df.withColumn(steps[0], word_hashes(F.col(text)))
    words = F.col(steps[0])
    shingle = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    hashes = F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), shingle))
    hashes = hashes.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    # A last value in every bin stands for "empty" and gives each bin a place in the sorted list.
    ends = F.expr(f"transform(sequence(0, {BINS - 1}), b -> shiftleft(cast(b - {BINS // 2} as bigint), 56) | 72057594037927935L)")
    df = df.withColumn(steps[1], F.sort_array(F.concat(hashes, ends)))
    ordered = steps[1]
    smallest = F.expr(f"filter({ordered}, (x, i) -> i = 0 or shiftright(x, 56) <> shiftright({ordered}[i - 1], 56))")
    full = F.transform(smallest, lambda x: F.when(x.bitwiseAND(F.lit((1 << 56) - 1)) != (1 << 56) - 1, x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))
    df = df.withColumn(steps[2], full)
    last = steps[2]
    for probe, step in enumerate(steps[3:-1]):
        borrowed = F.expr(f"transform({last}, (v, i) -> coalesce(v, {steps[2]}[cast(pmod(xxhash64({probe}, i), {BINS}) as int)]))")
        df = df.withColumn(step, F.when(F.exists(F.col(last), lambda v: v.isNull()), borrowed).otherwise(F.col(last)))
        last = step
    # The full bins as bin and value in one number; a bin's random order of them is that of hashes of both bins.
    full_bins = F.expr(f"filter(transform({steps[2]}, (v, j) -> shiftleft(j, {BITS}) | v), z -> z is not null)")
    df = df.withColumn(steps[-1], F.when(F.exists(F.col(last), lambda v: v.isNull()), full_bins))
    first_full = f"array_min(transform({steps[-1]}, z -> shiftleft(shiftright(xxhash64(i, shiftright(z, {BITS})), {BITS + 1}), {BITS}) | (z & {(1 << BITS) - 1})))"
    rest = F.expr(f"transform({last}, (v, i) -> if(v is null, coalesce({first_full}, -1L), v))")
    df = df.withColumn("_values", F.when(F.col(steps[-1]).isNotNull(), rest).otherwise(F.col(last).cast("array<bigint>")))
    per_word = 64 // BITS
    # The size guard names the values a second time, which keeps them computed once, not once per word.
    words = F.expr(
        f"if(size(_values) = {BINS}, transform(sequence(0, {BINS // per_word - 1}), w -> aggregate(slice(_values, w * {per_word} + 1, {per_word}), 0L, "
        f"(acc, v) -> shiftleft(acc, {BITS}) | (v & {(1 << BITS) - 1}))), null)"
    )
    return df.withColumn(out, words).drop(*steps, "_values")


def packed(words: Column) -> Column:
    """Hex digits of the low bits, a bin each."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness: the share of equal bins without those that agree by chance.

    A text without words is like another one without words (1) and unlike every other text (0).
    """
    chance = 2.0**-BITS
    wordless = F.array(*[F.lit(-1).cast("bigint")] * (BINS * BITS // 64))
    low = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(F.shiftright(d, 2)).bitwiseOR(F.shiftright(d, 3)).bitwiseAND(low))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda n, d: n + d)
    corrected = ((BINS - unequal) / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((a == wordless) | (b == wordless), 0.0).otherwise(F.greatest(F.lit(0.0), corrected))


def id_blocks(df: DataFrame, order: str, block_docs: int = BLOCK_DOCS, cells: int = CELLS) -> Column:
    """The number of a row's block, ascending with the id: about ``block_docs`` rows each, nulls in block -1.

    Quantiles cut the id order into cells, and each cell is cut into blocks of equal id width.
    """
    cuts = F.percentile_approx(order, F.array(*[F.lit(i / cells) for i in range(1, cells)]), 10000)
    seen = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(order).alias("n"), cuts.alias("cuts")).first()
    if seen["lo"] is None:
        return F.lit(-1).cast("bigint")
    starts = sorted({seen["lo"], *seen["cuts"]})
    at, rows, blocks, cell_of = F.col(order).cast("bigint"), -(-seen["n"] // cells), 0, []
    for lo, end in zip(starts, [*starts[1:], seen["hi"] + 1], strict=True):
        width = max(1, -(-(end - lo) * block_docs // rows))
        kind = "bigint" if end - lo < 1 << 62 else "decimal(38,0)"  # the distance can pass 64 bits
        place = F.call_function("div", at.cast(kind) - F.lit(lo).cast(kind), F.lit(str(width)).cast(kind))
        cell_of.append((end, F.lit(blocks) + place))
        blocks += -(-(end - lo) // width)
    last = cell_of.pop()[1]
    found = None
    for end, block in cell_of:
        found = F.when(at < end, block) if found is None else found.when(at < end, block)
    return F.when(at.isNull(), F.lit(-1).cast("bigint")).otherwise(last if found is None else found.otherwise(last))


def with_neighbour(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, text) -> text, edited and both fingerprints, and that of the next document (of the first after the last).

    Rows are dealt to blocks of the id order; windows find the neighbour inside a block, after one
    shuffle of the texts, and only the first row of each block crosses blocks.
    """
    block = id_blocks(docs, "doc_id", block_docs)
    rows = docs.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumns({"_next": F.lead("text").over(inside), "_starts": F.lag(F.lit(1)).over(inside).isNull()})
    heads = rows.where("_starts").select("_block", F.col("text").alias("_head"))
    # One row per block, ids only: the next block that holds rows, after the last one the first.
    blocks = docs.select(block.alias("_block")).distinct()
    after = blocks.select(F.col("_block").alias("_from"), F.lead("_block").over(Window.orderBy("_block")).alias("_block"))
    after = after.join(F.broadcast(blocks.agg(F.min("_block").alias("_first"))))
    after = after.select("_from", F.coalesce("_block", "_first").alias("_block"))
    ends = heads.join(after, "_block").select(F.col("_from").alias("_block"), "_head")
    rows = rows.join(ends.hint("merge"), "_block").withColumn("_last", F.col("_next").isNull())
    rows = with_edited(rows.withColumn("_next", F.coalesce("_next", "_head")))
    rows = with_fingerprint(with_fingerprint(rows, "text", "bins"), "edited", "edited_bins")
    # Of the head only a block's last row needs the fingerprint.
    rows = with_fingerprint(rows.withColumn("_head", F.when(F.col("_last"), F.col("_head"))), "_head", "_head_bins")
    following = F.when(F.col("_last"), F.col("_head_bins")).otherwise(F.lead("bins").over(inside))
    return rows.withColumn("next_bins", following).drop("_block", "_next", "_starts", "_head", "_last", "_head_bins")


def with_edited(df: DataFrame) -> DataFrame:
    """Add n_chars and ``edited``: the second half of the text replaced by the next document's first characters."""
    half = F.expr("cast(n_chars div 2 as int)")
    df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    start = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)
    return df.withColumn("edited", F.concat(start, F.substring(F.col("_next"), F.lit(1), half)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, n_chars, and the fingerprints bins, edited_bins and next_bins (of the next document)."""
    return with_neighbour(docs.select("doc_id", blank(F.col("text")).alias("text")))
