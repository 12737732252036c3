"""Line dedup: range-partitioned line hashes, streamed first occurrences, keep bitmaps.

Only hashes, document ids and line numbers are shuffled.  They are range partitioned by (hash,
document descending) and sorted by (hash, document, row, position) inside each partition, so a
line that a third of all documents share is cut between partitions by its documents.  The sorted
stream marks the first occurrence of a line in each document; marked rows are summed per hash
(combined before the shuffle) to the number of documents and the document that keeps the line.
The decisions come back as one bitmap per document, 64 lines a word.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` takes no part and keeps
its lines; rows that repeat a ``doc_id`` are the same document (they count once for a key, and all
lose or keep it); an empty table gives an empty result; other columns are carried in one struct
and so cannot clash.  A hash has 96 bits (xxhash64 and murmur3 of the key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, staged

MIN_CHARS, MIN_DOCS = 20, 3
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
#: What stripping takes off: the characters of EDGE.
EDGE_CHARS = " \t\n\x0b\x0c\r"
WORD_BITS = 64


def line_key(line: Column) -> Column:
    """Stripped at both ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(EDGE_CHARS))
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: Column) -> Column:
    return F.split(blank(text), "\n", -1)


def _row_id(text: Column) -> Column:
    return F.xxhash64(blank(text))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, rid, pos) of every line that goes; repeated rows repeat theirs."""
    lines = docs.where("doc_id is not null").select("doc_id", _row_id(F.col("text")).alias("rid"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "rid", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = lines.select("doc_id", "rid", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    ordered = hashed.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc_id").desc())
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("rid", "pos")
    marked = staged(ordered.withColumn("first", F.row_number().over(stream) == 1), "lines")
    keys = marked.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    # Staged, so that both sides of the join are plain shuffles and a very common line can be split among tasks.
    keys = staged(keys.where(F.col("n_docs") >= min_docs).drop("n_docs"), "line-keys")
    return marked.join(keys, ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "rid", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, rid, n_dropped, keep array<bigint>) of documents that lose lines.

    Bit ``pos % 64`` of word ``pos / 64`` is 1 if the line stays.  Words after the last dropped
    line are left out, and so are documents that keep everything.
    """
    gone = dropped_lines(docs, min_chars, min_docs)
    word = (F.col("pos") / WORD_BITS).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD_BITS} as int))")
    words = gone.groupBy("doc_id", "rid", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = words.groupBy("doc_id", "rid").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")
    )
    # Words without a dropped line are not in the list: the gaps before each entry are filled with "all stay".
    filled = F.expr(
        "flatten(transform(words, (w, i) -> concat("
        "array_repeat(-1L, w.word - if(i = 0, 0, words[i - 1].word + 1)), array(~w.bits))))"
    )
    return packed.select("doc_id", "rid", "n_dropped", filled.alias("keep"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` (all columns of docs), n_lines, n_dropped and the bitmap ``keep`` (null: everything stays)."""
    maps = keep_bitmaps(docs, min_chars, min_docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), _row_id(F.col("text")).alias("rid"))
    joined = rows.join(maps, ["doc_id", "rid"], "left")
    n_lines = F.size(_lines(F.col("row.text"))).cast("bigint")
    return joined.select("row", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep")


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that the bitmap drops."""
    def stays(_line: Column, i: Column) -> Column:
        word = F.get(keep, (i / WORD_BITS).cast("int"))
        return F.coalesce(F.getbit(word, i % WORD_BITS) == 1, F.lit(True))

    return F.when(keep.isNull(), blank(text)).otherwise(F.array_join(F.filter(_lines(text), stays), "\n"))
