"""Token counts of flat, unindexed token files by separator scan.

A flat file is a run of little-endian ids, each document closed by the end-of-document id; nothing
says where documents begin.  Files are cut into byte blocks; each block is searched for the end id
with one vector comparison.  A prefix scan over the block summaries of a file (ends seen so far,
place of the last end) stitches documents across blocks, however many blocks one document covers.

Files are written and read through ``pyarrow.fs``, so a folder may lie in any store it knows; a
task writes under its own name and renames at the end, so a repeated task leaves one whole file.

Defined cases: an empty text has 0 tokens; tokens behind the last end id are a document that is
not ``closed``; an empty file has none; a null text reads as empty and a null ``doc_id`` stays null;
repeated rows are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, staged_path
from .tokens import END_ID, Encoder

BLOCK_BYTES, ID_TYPE = 1 << 22, "<u2"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_token_files(docs: DataFrame, folder: str, end: int = END_ID, id_type: str = ID_TYPE, file: str | None = None, ranks: str | None = None) -> DataFrame:
    """Tokenise documents into one flat file per partition; returns (file, ordinal, doc_id), already written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, ordinal = Encoder(file, ranks, special_as_text=True), 0
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/tokens-{TaskContext.get().partitionId():06d}.bin"
        draft = f"{root}/_draft-{uuid4().hex}"
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for text in batch["text"]:
                    out.write(np.append(encoder.encode(text), np.uint32(end)).astype(id_type).tobytes())
                n = len(batch)
                yield pd.DataFrame({"file": name.rpartition("/")[2], "ordinal": np.arange(ordinal, ordinal + n), "doc_id": batch["doc_id"].astype("Int64")})
                ordinal += n
        store.move(draft, name)

    return staged(docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(write, "file string, ordinal bigint, doc_id bigint"), "token-index")


def count_tokens(files: DataFrame, folder: str, end: int = END_ID, id_type: str = ID_TYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file) -> file, ordinal, start (ids before the document), n_tokens, closed for every document of the named files."""
    width = np.dtype(id_type).itemsize
    if block_bytes % width:
        raise ValueError("a block holds whole ids")

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "n_ids": [store.get_file_info(f"{root}/{f}").size // width for f in batch["file"]]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for batch in batches:
            for name, n_ids, block in zip(batch["file"], batch["n_ids"], batch["block"], strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(block_bytes, int(block) * block_bytes), id_type, count=-1)
                ends = np.flatnonzero(ids == end) + int(block) * (block_bytes // width)
                yield pd.DataFrame({"file": [name], "n_ids": [n_ids], "block": [block], "ends": [ends]})

    sized = files.select("file").distinct().mapInPandas(sizes, "file string, n_ids bigint").where("n_ids > 0")
    per = block_bytes // width
    blocks = sized.select("file", "n_ids", F.explode(F.expr(f"sequence(0L, (n_ids - 1) div {per}L)")).alias("block"))
    found = blocks.repartition("file", "block").mapInPandas(scan, "file string, n_ids bigint, block bigint, ends array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = staged(found, "ends").withColumns({
        "base": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        "open": F.coalesce(F.max(F.expr("get(ends, size(ends) - 1)")).over(before) + 1, F.lit(0)),
    })
    docs = stitched.select("file", "base", "open", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.expr("get(ends, i - 1) + 1"))
    closed = docs.select("file", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = stitched.where(F.col("block") == F.expr(f"(n_ids - 1) div {per}L")).select("file", "n_ids", (F.col("base") + F.size("ends")).alias("ordinal"), F.coalesce(F.expr("get(ends, size(ends) - 1) + 1"), "open").alias("start"))
    tails = tails.where("n_ids > start").select("file", "ordinal", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionAll(tails)


def document_token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens: documents written to flat files in the shared folder and counted there."""
    folder = staged_path(docs.sparkSession, "tokens")
    index = write_token_files(docs, folder)
    counts = count_tokens(index.select("file"), folder)
    return index.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
