"""Exact top-k search: exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight), a term being a component.  Queries and candidates are
dealt to blocks by hash and every query block meets every candidate block, as far as the stated
query set asks.  A task turns its candidates into postings (for each term the candidates that hold
it and their weights), and for each term the query rows scatter their weighted postings into dense
score arrays.  Each query then selects its best by partition selection, and the selections of all
candidate blocks are merged.  A task holds one query block and one candidate block.

Defined cases: a null vector, one with a null or non-finite component, and a null id take no part;
a missing component is 0; a scaled component or a score beyond 64 bits is an error; equal scores go to
the smaller id; a query meets no row of its own id; repeated rows are separate candidates, and of a
repeated query id the smallest vector asks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES, CANDIDATES, STRIP = 2048, 16384, 128


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale x component); null unless every component is a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    wide = F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= 2.0**63)
    ints = F.when(wide, F.raise_error(F.lit("a scaled component does not fit 64 bits"))).otherwise(ints)
    return F.when(vector.isNotNull() & ~bad, ints)


def _dense(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries against all candidates, term by term over the non-zero weights."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(queries.shape[1]):
        asking = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(candidates[:, term])
        if not len(asking) or not len(posting):
            continue
        gain = np.multiply.outer(queries[asking, term], candidates[posting, term])
        if len(asking) == len(queries) and len(posting) == len(candidates):
            scores += gain
        elif len(posting) == len(candidates):
            scores[asking] += gain
        else:
            scores[np.ix_(asking, posting)] += gain
    return scores


def scores_of(queries: np.ndarray, candidates: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Scores in 64 bits; where sums could leave them they are made exactly, and one that does is an error (but of a row and itself)."""
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (queries, candidates)]
    if top[0] * top[1] * max(1, queries.shape[1]) < 2**63:
        return accumulate(queries, candidates)
    exact = np.where(same, 0, queries.astype(object) @ candidates.T.astype(object))
    if max(abs(int(exact.max())), abs(int(exact.min()))) >= 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best of each row: higher score, then smaller id; own ids left out."""
    scores = np.where(ids[None, :] == own[:, None], np.iinfo(np.int64).min, scores)
    if len(ids) > k:
        edge = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        edge = scores.min(axis=1)
    row, col = np.nonzero((scores >= edge[:, None]) & (ids[None, :] != own[:, None]))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates among all other rows."""
    ints = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), is_query.alias("asks")).where("v is not null and vec_id is not null")
    # Of equal rows no more than k can ever be among the best: so many copies of one row cannot fill a block.
    ints = ints.groupBy("vec_id", "v", "asks").agg(F.count("*").alias("copies"))
    ints = ints.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    asked = ints.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    n = ints.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    cand_blocks, query_blocks = max(1, -(-n["n"] // candidates)), max(1, -(-n["q"] // queries))
    block = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = ints.withColumn("c", block(cand_blocks)).select("vec_id", "v", "c", every(query_blocks).alias("q"))
    right = asked.withColumn("q", block(query_blocks)).select("vec_id", "v", "q", every(cand_blocks).alias("c"))

    def search(cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(cand) and len(query):
            width = max(cand["v"].map(len).max(), query["v"].map(len).max())
            ids, own = cand["vec_id"].to_numpy(np.int64), query["vec_id"].to_numpy(np.int64)
            terms, asks = _dense(cand["v"], width), _dense(query["v"], width)
            for at in range(0, len(own), STRIP):
                scores = scores_of(asks[at : at + STRIP], terms, ids[None, :] == own[at : at + STRIP, None])
                row, col = best(scores, ids, own[at : at + STRIP], k)
                out["query_id"] += own[at + row].tolist()
                out["vec_id"] += ids[col].tolist()
                out["score"] += scores[row, col].tolist()
        return pd.DataFrame(out)

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
