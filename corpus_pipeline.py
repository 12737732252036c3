"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read back as the next
stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import line_dedup, mixing, near_copies, packing, toxicity
from logloom.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays below one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a later document repeats; n_chars follows the text."""
    kept = line_dedup.line_dedup(docs)
    text = F.when(F.col("row.text").isNotNull(), line_dedup.kept_text(F.col("row.text"), F.col("keep")))
    rows = kept.select("row", text.alias("kept"))
    changed = {"text": F.col("kept"), "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: pairs from SimHash balls and MinHash keys, decided by five-word shingles at similarity 0.8; rows without an id stay."""
    found = near_copies.near_copies(docs)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionAll(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy, shards together and shuffled inside; a copy of which less than half is due is left out."""
    copies = mixing.mixture(mixing.mix_sources(docs))
    return copies.where(F.col("words") * 2 >= F.col("size")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_duplicates), ("mixing", mix), ("packing", pack)]
#: Training, hashing, seeded draws and token ids have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
