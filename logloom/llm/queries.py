"""Registered queries of the training-data operators with their cross-check SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints as fp
from . import collocations, html_extract, language, line_dedup, mixing, packing, simhash, spelling, substring_dedup, token_counts, topk, toxicity
from .common import in_training, table

def held_out() -> Column:
    return (~in_training(F.col("doc_id"))).alias("held_out")



def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"])
    return mixed.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    rated = rated.select(F.col("row.doc_id").alias("doc_id"), "score", F.size("spans").alias("n_offending"))
    return rated.select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), language.public_vocabulary()
    langs, prob = language.train(docs, vocabulary)
    rated = language.identify(docs.select("doc_id", "text"), langs, prob, vocabulary)
    return rated.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", held_out(), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = line_dedup.kept_text(F.col("row.text"), F.col("keep"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fp.fingerprint_documents(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fp.packed(F.col("bins")).alias("fingerprint"),
        fp.packed(F.col("edited_bins")).alias("edited_fingerprint"), fp.likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        fp.likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return got.withColumn("n_chars", F.length("text").cast("bigint"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH ints AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
terms AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS t FROM ints),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM terms q JOIN terms c ON q.t = c.t AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT d, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM texts),
lists AS (SELECT d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT d, lang, p, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM lists),
runs AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY d, p ORDER BY i)),
sizes AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
f1 AS (SELECT lang, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1 || ' ' || w2 AS phrase, w1 AS h, w2 AS t, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT f2.lang, f2.phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.phrase = f2.h JOIN f1 y ON y.lang = f2.lang AND y.phrase = f2.t
  UNION ALL
  SELECT f3.lang, f3.phrase, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.phrase = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.h = f3.w2 AND y.t = f3.w3
  UNION ALL
  SELECT f3.lang, f3.phrase, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.h = f3.w1 AND x.t = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.phrase = f3.w3),
rated AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
worst AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
over AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN over USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flat AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts),
spans AS (
  SELECT doc_id, word, pos, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n
  FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
judged AS (
  SELECT doc_id, word, pos, n = 20 AND row_number() OVER (PARTITION BY n, seq ORDER BY doc_id, pos) > 1 AS repeated FROM spans),
marked AS (
  SELECT doc_id, word, pos,
         bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


def registered() -> tuple[dict, dict[str, str]]:
    queries = [
        op1_mix_sources, op2_toxicity, op3_language, op4_line_dedup, op5_fingerprints, op6_token_counts,
        op7_html_text, op8_simhash, op9_top_k, op10_best_fit_packing, op11_spelling_groups, op12_collocations, op13_substring_dedup,
    ]
    return {q.__name__: q for q in queries}, {"op4_line_dedup": OP4_SQL, "op9_top_k": OP9_SQL, "op12_collocations": OP12_SQL, "op13_substring_dedup": OP13_SQL}
