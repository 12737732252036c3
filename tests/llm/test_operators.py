"""The training-data operators against brute force, with nulls, empties, ties, repeats and clashing names."""

import html
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import fingerprints, html_extract, language, line_dedup, mixing, near_copies, packing, queries, simhash, token_counts, topk, toxicity
from logloom.llm.tokens import Encoder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "The quick brown fox jumps over it"


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, and columns whose names the operators use themselves."""
    rows = [
        (1, f"{LONG}\nown line one\n  {LONG.upper()} \t", "en", "b", 9),
        (2, f"x\n{LONG}", "en", "b", 9),
        (3, LONG, "de", None, 9),
        (4, None, None, "a", None),
        (5, "", "fr", "a", 0),
        (6, "\x0b\x0c \t", "fr", "c", 3),
        (7, "word " * 3000, "en", "c", 15000),
        (7, "word " * 3000, "en", "c", 15000),
        (None, LONG, "en", "a", 9),
        (9, "été 中文 𝒳 <|endoftext|> end", "fr", "a", 20),
        (-5, f"{LONG}\r\n{LONG}", "en", "b", 5),
    ]
    wide = docs_of(spark, rows)
    for name in ("row", "key", "size", "bucket", "score", "keep", "part", "turn", "line", "pos", "h1"):
        wide = wide.withColumn(name, F.lit("clash"))
    return wide


def components_of(values, near):
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


# op1 --------------------------------------------------------------------------------------------


def targets_by_rounds(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = goal - sum(most * sizes[s] for s in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[t] for t in free) for s in names}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("shard_draws", [3, 256])
def test_mixing(spark, odd, shard_draws):
    mixed = mixing.mix_sources(odd, shard_draws=shard_draws)
    rows = mixed.select("row.*", "target", "source_size", F.col("copies"), mixed["size"].alias("n")).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += r.n
        taken[r.source] += sum(c.words for c in r.copies)
        assert sum(c.words for c in r.copies) <= 2 * r.n
    expected = targets_by_rounds(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 1
    again = mixing.mix_sources(odd.repartition(3), shard_draws=shard_draws).select("row.doc_id", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixed.select("row.doc_id", "copies").collect())
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_mixing_cuts_large_tables_into_more_blocks(spark, odd, monkeypatch):
    taken = {}
    for buckets, block_rows in ((2, 10**6), (2, 3)):
        monkeypatch.setattr(mixing, "BUCKETS", buckets)
        monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
        rows = mixing.mix_sources(odd, shard_draws=2).select("row.source", "target", "copies").collect()
        taken[block_rows] = Counter()
        for r in rows:
            taken[block_rows][r.source, round(r.target)] += sum(c.words for c in r.copies)
    assert taken[3] == taken[10**6] and all(abs(n - target) <= 1 for (_, target), n in taken[3].items())


def test_splitting_tree_is_exact(spark):
    quotas = {f"s{i}": 7 * i * i + 1 for i in range(9)}
    got = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "key string, n bigint"), 100, levels=3).toPandas()
    assert got.groupby("key")["n"].sum().to_dict() == quotas
    per = got.groupby("shard")["n"].sum()
    assert set(per.index) == set(range(100)) and per.max() - per.min() <= 7


# op2 --------------------------------------------------------------------------------------------


def test_toxicity_noisy_or():
    model = {"": -5.0, "scum": 4.0, "vequ-": 6.0}
    scorer = toxicity.Scorer(model)
    p = lambda z: 1 / (1 + np.exp(-z))
    for text, logits in (("", [-5]), ("Fine day. You SCUM! ok", [-5, -1, -5]), ("vequta x\nvequ", [1, -5]), ("?!..", [-5])):
        score, spans = scorer.score(text)
        assert abs(score - (1 - np.prod([1 - p(z) for z in logits]))) < 1e-9
        assert [text[s["start"] : s["end"]] for s in spans] == ["vequta x"] * (text[:6] == "vequta")


def test_toxicity_learns_held_out(spark):
    source = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(source, labels)
    rated = toxicity.score_documents(source.join(labels.select("doc_id"), "doc_id", "left_semi"), model)
    rated = rated.select("row.doc_id", "score").join(labels, "doc_id").toPandas()
    held = rated[[zlib.crc32(str(d).encode()) % 5 == 0 for d in rated["doc_id"]]]
    clean, toxic = held[held["toxic"] == 0], held[held["toxic"] == 1]
    assert (clean["score"] < 0.5).mean() > 0.99 and (toxic["score"] >= 0.5).mean() > 0.8


def test_toxicity_sample_holds_a_repeated_id_once(spark):
    rows = [(i, "you are scum" if i % 2 else "fine day", None, None, 0) for i in range(40)] + [(1, "a fine day", None, None, 0)] * 200
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    once = toxicity.train(docs_of(spark, rows[:1] + rows[2:41]), labels)
    assert toxicity.train(docs_of(spark, rows), labels) == once


def test_toxicity_length_alone_does_not_offend():
    scorer = toxicity.Scorer({"": -6.8, "scum": 8.0, "fool": 3.0})
    clean, offending = "A fine day. " * 50_000, "A fine day. " * 50_000 + "You scum."
    assert scorer.score(clean) == (pytest.approx(0.05), []) and scorer.score("A fool. " + clean)[0] < 0.5
    score, spans = scorer.score(offending)
    assert score >= 0.5 and [offending[s["start"] : s["end"]].strip() for s in spans] == ["You scum."]


def test_toxicity_weighs_classes_by_their_labels(spark):
    """Nine of ten documents are clean; a sample that draws as many of either class must not read as one to one."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 10 == 0
        words = ["day", "sun", "rain"] + ["scum"] * (rng.random() < (0.9 if toxic else 0.1))
        rows.append((i, " ".join(words) + ".", None, None, 0))
        labels.append((i, int(toxic)))
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    whole, part = toxicity.train(docs, known), toxicity.train(docs, known, sample=150)
    score = lambda model: toxicity.Scorer(model).score("day sun rain scum.")[0]
    truth = [int(t) for d, t in labels if zlib.crc32(str(d).encode()) % 5 and "scum" in rows[d][1]]
    assert abs(score(whole) - np.mean(truth)) < 0.05 and abs(score(part) - score(whole)) < 0.1


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, None), (99, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    scored = toxicity.score_documents(odd, model).collect()
    assert len(scored) == odd.count() and all(r.score < 0.01 for r in scored)


# op3 --------------------------------------------------------------------------------------------


def segmentations(word, index, unknown):
    for cuts in product([0, 1], repeat=len(word) - 1):
        pieces, start = [], 0
        for i, cut in enumerate([*cuts, 1], 1):
            if cut:
                pieces.append(word[start:i])
                start = i
        ids = [index.get(p, unknown if len(p) == 1 else None) for p in pieces]
        if None not in ids:
            yield ids


def test_forward_sums_all_segmentations():
    index = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "bab", "▁ab"])}
    rng = np.random.default_rng(0)
    prob = rng.random((len(index) + 1, 2))
    words = ["▁abab", "▁bbab", "▁axba"]
    reader = language.Reader(index, prob)
    reader.learn(set(words))
    for word in words:
        exact = sum(np.prod(prob[ids], axis=0) for ids in segmentations(word, index, len(index)))
        assert np.allclose(np.exp(reader.logs[reader.known[word]]), exact)


def test_em_matches_enumeration():
    index = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a"])}
    counts = {"▁ab": 3, "▁aab": 2}
    prob = np.full(len(index) + 1, 1 / (len(index) + 1))
    expected = np.zeros(len(index) + 1)
    for word, n in counts.items():
        ways = list(segmentations(word, index, len(index)))
        weights = np.array([np.prod(prob[w]) for w in ways])
        for way, share in zip(ways, weights / weights.sum(), strict=True):
            np.add.at(expected, way, n * share)
    assert np.allclose(language.fit_pieces(counts, index, rounds=1), expected)


def test_language_query(spark, odd):
    got = queries.op3_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and len(held) > 100
    vocabulary = language.public_vocabulary()
    langs, prob = language.train(odd, vocabulary)
    rows = language.identify(odd, langs, prob, vocabulary).select("row.text", "lang_pred", "score").collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) and 0 <= r.score <= 1 for r in rows)
    signs = docs_of(spark, [(1, "½ ² 3 _ Ⅷ !", None, None, 0), (2, "½a", None, None, 0)])
    assert [r.lang_pred == "und" for r in language.identify(signs, langs, prob, vocabulary).orderBy("row.doc_id").collect()] == [True, False]
    none = language.identify(odd, *language.train(odd.limit(0), vocabulary), vocabulary)
    assert {r.lang_pred for r in none.collect()} == {"und"}


# op4 --------------------------------------------------------------------------------------------


def dedup_by_hand(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n") if doc_id is not None else ():
            holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [doc_id is not None and len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != doc_id for x in lines]
        out.append((str(doc_id), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out)


def test_line_dedup(spark, odd):
    rng = np.random.default_rng(3)
    many = [(i, "\n".join(f"shared line number {k:04d} of the set" for k in rng.integers(0, 40, 200))) for i in range(30)]
    for table in (odd.select("doc_id", "text", "row", "keep"), spark.createDataFrame(many, "doc_id bigint, text string")):
        kept = line_dedup.line_dedup(table)
        text = line_dedup.kept_text(F.col("row.text"), F.col("keep"))
        got = kept.select("row.doc_id", "n_lines", "n_dropped", text.alias("kept")).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got) == dedup_by_hand([(r.doc_id, r.text) for r in table.collect()])
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


# op5 --------------------------------------------------------------------------------------------


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(spark, odd):
    rows = fingerprints.fingerprint_documents(odd).select("*", fingerprints.likeness(F.col("bins"), F.col("edited_bins")).alias("near")).collect()
    ordered = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    texts = [t for _, _, t in ordered]
    expected = []
    for i, (_, _, t) in enumerate(ordered):
        half = len(t) // 2
        expected.append((t, t[: len(t) - half] + texts[(i + 1) % len(texts)][:half], len(t)))
    assert sorted((r.text, r.edited, r.n_chars) for r in rows) == sorted(expected)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text].add(tuple(r.bins))
        if r.text == r.edited:
            assert r.near == 1
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprint_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block_docs", [1, 7, 1000])
def test_next_document_crosses_blocks(spark, block_docs):
    docs = spark.createDataFrame([(i * i, f"text {i}") for i in range(60)], "doc_id bigint, text string")
    got = {r.doc_id: tuple(r.next_bins) for r in fingerprints.with_neighbour(docs, block_docs).collect()}
    own = {r.doc_id: tuple(r.bins) for r in fingerprints.with_neighbour(docs).collect()}
    assert got == {i * i: own[(i + 1) ** 2 if i < 59 else 0] for i in range(60)}


@pytest.mark.parametrize("block_docs", [1, 10])
def test_blocks_follow_clustered_ids(spark, block_docs):
    ids = [*range(500), *range(10**15, 10**15 + 500), -(2**63), 2**63 - 1, *[77] * 3, None]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    rows = docs.select("doc_id", fingerprints.id_blocks(docs, "doc_id", block_docs).alias("block")).collect()
    known = sorted((r.doc_id, r.block) for r in rows if r.doc_id is not None)
    assert [b for _, b in known] == sorted(b for _, b in known) and min(known)[1] >= 0
    assert {r.block for r in rows if r.doc_id is None} == {-1}
    assert max(Counter(b for _, b in known).values()) <= 60


def test_likeness_is_near_jaccard(spark, sf):
    rows = fingerprints.fingerprint_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = rows.select("text", "edited", fingerprints.likeness(F.col("bins"), F.col("edited_bins")).alias("near")).collect()
    errors = []
    for r in rows:
        a, b = shingles(r.text), shingles(r.edited)
        if len(a | b) > 100:
            errors.append(r.near - len(a & b) / len(a | b))
    assert len(errors) > 100 and abs(np.mean(errors)) < 0.01 and np.abs(errors).mean() < 0.04


# op6 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block_bytes):
    rng = np.random.default_rng(4)
    files = {"a.bin": [0, 3, 0, 40, 1], "b.bin": [5], "c.bin": []}
    expected = []
    for name, lengths in files.items():
        ids = np.concatenate([np.append(rng.integers(0, 100, n), 999) for n in lengths] or [[]]).astype("<u2")
        if name == "b.bin":
            ids = np.append(ids, [7, 7]).astype("<u2")  # no end id
            lengths = [*lengths, 2]
        ids.tofile(tmp_path / name)
        start = 0
        for k, n in enumerate(lengths):
            expected.append((name, k, start, n, not (name == "b.bin" and k == 1)))
            start += n + 1
    names = spark.createDataFrame([(n,) for n in files], "file string")
    got = token_counts.count_tokens(names, str(tmp_path), end=999, block_bytes=block_bytes)
    assert sorted(tuple(r) for r in got.select("file", "ordinal", "start", "n_tokens", "closed").collect()) == sorted(expected)


def test_document_token_counts(spark, odd):
    encoder = Encoder(special_as_text=True)
    got = token_counts.document_token_counts(odd).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={r.doc_id}, n_tokens={len(encoder.exact.encode(r.text or '', add_special_tokens=False).ids)})" for r in odd.collect())
    assert token_counts.document_token_counts(odd.limit(0)).count() == 0


def test_fast_ids_equal_exact_ids(spark, sf):
    encoder = Encoder()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [" \n\t  x  ", "a b", "don't DON'T ’s", "½ ² ª º", "ǅ ʼn", "x" * 500, "    ", "\r\n\r\n a"]
    for text in texts:
        assert encoder.encode(text).tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


# op7 --------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
<header>Site</header><nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="post-%d"><h1>Head &amp; <b>bo</b>ld</h1><p>First   text<br>line<p>Second &lt;p&gt; <!-- no --> text
<script>var a = "</p><p>no";</script><div class="ad">Buy</div><form><input>Search</form><table><tr><td>c1<td>c2</table></div>
<aside>Side</aside><div class="sidebar">Links and words that are no article</div></div>
<section id="comments"><p>A reader says a lot here, really a lot, more than the article itself holds in words.</p></section>
<footer>&copy; Site</footer></body></html>"""
ARTICLE = "Head & bold First text line Second <p> text c1 c2"


def test_html_extraction(spark, sf):
    rows = [(i, "https://Host.example:80/a", PAGE % i) for i in range(5)]
    rows += [(10, None, None), (11, "x", ""), (12, "https://host.example/b", "<p>only & text"), (13, "https://o.example/", "<div>" * 50 + "deep")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("clash"), "host": F.lit("clash"), "path": F.lit(1)})
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got == dict.fromkeys(range(5), ARTICLE) | {10: "", 11: "", 12: "only & text", 13: "deep"}
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_html_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract_pages(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
        assert r.text == " ".join(b for b in blocks if b)


# op8 --------------------------------------------------------------------------------------------


def test_simhash_fingerprint():
    import xxhash

    for text in ("", None, "one two", "a b c d e f a b c d", "É A"):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes) > 0)


@pytest.mark.parametrize("group", [4096, 30, 3])
def test_links_keep_all_components(spark, group):
    rng = np.random.default_rng(5)
    values = set()
    for base in rng.integers(-(2**62), 2**62, 6):
        for _ in range(50):
            values.add(int(base) ^ sum(1 << int(b) for b in set(rng.integers(0, 62, rng.integers(0, 6)))))
    values = sorted(values)
    root = components_of(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    nodes = spark.createDataFrame([(v,) for v in values], "fp bigint")
    got = {v: v for v in values} | {r.node: r.label for r in simhash.components(simhash.links(nodes, group)).collect()}
    assert got == {v: values[root[i]] for i, v in enumerate(values)}


def test_simhash_edges(spark, odd):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert {k[0]: v for k, v in got.items()}[None] is None
    empties = {k[0]: v for k, v in got.items() if k[1] == 0}
    assert empties == {4: 4, 5: 4, 6: 4}
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(odd.limit(0)).count() == 0


# near copies of the pipeline ---------------------------------------------------------------------


def jaccard(a, b):
    a, b = shingles(a or ""), shingles(b or "")
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_copies():
    """Families of copies with a few words changed, a chain of edits, and one family larger than the others."""
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 5000)}"
    texts = []
    for family in range(12):
        base = [word() for _ in range(int(rng.integers(60, 400)))]
        last = base
        for copy in range(40 if family == 0 else 5):
            words = list(last if family % 3 == 1 else base)
            for at in rng.integers(0, len(words), max(1, len(words) // int(rng.integers(45, 90)))):
                words[at] = word()
            texts.append(" ".join(words))
            last = words
    return texts + [" ".join(word() for _ in range(80)) for _ in range(20)] + [None, "", " ", "a b c", "A  b c"]


def test_near_copies_of_edited_texts(spark):
    texts = edited_copies()
    root = components_of(texts, lambda a, b: jaccard(a, b) >= 0.8)
    ids = [3 * i - 50 for i in range(len(texts))]
    docs = docs_of(spark, [(i, t, None, None, 0) for i, t in zip(ids, texts, strict=True)] + [(None, texts[0], None, None, 0)])
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {i: ids[r] for i, r in zip(ids, root, strict=True)} | {None: None}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({*(ids[r] for r in root), None}, key=str)


def test_near_copies_edges(spark, odd):
    got = near_copies.near_copies(odd)
    assert got.count() == odd.count() and near_copies.near_copies(odd.limit(0)).count() == 0
    of = {r.doc_id: r.component_id for r in got.collect()}
    assert of[None] is None and of[4] == of[5] == of[6] == 4
    several = docs_of(spark, [(1, "one two three four five six", None, None, 0), (2, "other words stand here and there", None, None, 0), (2, "one two three four five six", None, None, 0), (3, "other words stand here and there", None, None, 0)])
    assert {r.component_id for r in near_copies.near_copies(several).collect()} == {1}


# op9 --------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 8) / 16]) for i in range(120)]
    rows += [(7, rows[7][1]), (50, None), (130, [None] * 8), (131, [float("nan")] * 8), (132, [float("inf")]), (None, [1.0] * 8), (133, []), (134, [0.5])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"score": F.lit("clash"), "v": F.lit(0), "c": F.lit(0)})
    valid = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q in {i: v for i, v in valid if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(q[1], v, strict=False)), i) for i, v in valid if i != q[0])[:5]
        expected += [(q[0], k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    for blocks in ((2048, 16384), (1, 9)):
        got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, queries=blocks[0], candidates=blocks[1])
        assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_keeps_64_bits(spark):
    schema = "vec_id bigint, embedding array<double>"
    rows = [(0, [1e7, 1.0]), (0, [2e7, 1.0]), (1, [1.0, 0.0]), (2, [-3e6, 7.0]), (3, [1e5, -1e9])]
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()
    quantised = lambda v: [int(np.floor(256 * x)) for x in v]
    expected = {i: sum(a * b for a, b in zip(quantised(rows[0][1]), quantised(v), strict=True)) for i, v in rows[2:]}
    # Of the two vectors of query 0 the smaller one asks.
    assert {r.vec_id: r.score for r in got} == expected and expected[1] == 655_360_000_000
    for wide in ([(0, [1e8, 1.0]), (1, [1e8, 1.0])], [(0, [1e17]), (1, [0.0])]):
        with pytest.raises(Exception, match="fit 64 bits"):
            topk.top_k(spark.createDataFrame(wide, schema), F.col("vec_id") == 0).collect()


# op10 -------------------------------------------------------------------------------------------


def packed_by_hand(lengths, limit):
    """One sequence after another, each filled and tightened by itself."""
    left, out = Counter(lengths), []
    while left:
        use = [max(left)]
        free = left - Counter(use)
        while fits := [x for x in free if x <= limit - sum(use)]:
            use.append(max(fits))
            free -= Counter([max(fits)])
        while len(use) > 1 and sum(use) < limit:
            small, room = min(use), limit - sum(use) + min(use)
            free = left - Counter(use)
            sums = [a + b for a in free for b in free if a <= b and small < a + b <= room and (a != b or free[a] > 1)]
            if not sums:
                break
            pair = max((a, b) for a in free for b in free if a <= b and a + b == max(sums) and (a != b or free[a] > 1))
            use.remove(small)
            use += pair
        out.append(tuple(sorted(use)))
        left -= Counter(use)
    return sorted(out)


def test_plan_equals_one_by_one():
    rng = np.random.default_rng(7)
    for _ in range(20):
        lengths = rng.integers(1, 60, rng.integers(1, 120)).tolist()
        plan, filled = packing.Plan(Counter(lengths), 60), defaultdict(list)
        placed = Counter()
        ends = {}
        for length, first, use, sequence, _offset in plan.rows:
            ends.setdefault(sequence, []).append((length, first, use))
        starts = sorted(ends) + [plan.sequences]
        for at, until in zip(starts, starts[1:], strict=False):
            for sequence in range(at, until):
                for length, _first, use in ends[at]:
                    filled[sequence] += [length] * use
                    placed[length] += use
        assert placed == Counter(lengths)
        assert sorted(tuple(sorted(v)) for v in filled.values()) == packed_by_hand(lengths, 60)


def test_packing(spark, odd):
    encoder = Encoder()
    got = packing.pack_documents(odd, limit=64).toPandas()
    rows = []
    for r in odd.collect():
        ids = encoder.exact.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            rows.append((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    same = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("Int64").values.tolist()
    assert sorted(map(str, same)) == sorted(str([x if x is not None else pd.NA for x in r]) for r in rows)
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one["length"].sum() <= 64 and (one["length"].cumsum() - one["length"] == one["offset"]).all()
    assert packing.pack_documents(odd.limit(0)).count() == 0


# the pipeline -----------------------------------------------------------------------------------


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).unionAll(docs_of(spark, [(900_001, LONG * 3, "en", None, 9), (900_002, LONG * 3, "en", "z", 9), (900_003, None, None, None, None)])).cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "packing":
            lengths = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
            assert {r.doc_id for r in out.collect()} == set(before) and max(r.n for r in lengths) <= 2048
            break
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= set(before)
        rows = out.collect()
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            scorer = toxicity.Scorer(model)
            assert {r.doc_id for r in rows} == {d for d, t in before.items() if scorer.score(t or "")[0] < 0.5}
        if name == "line_dedup":
            by_hand = {d: t for d, _, _, t in dedup_by_hand(list(before.items()))}
            assert all((r.text or "") == by_hand[str(r.doc_id)] for r in rows) and len(rows) == len(before)
        if name == "simhash":
            ids = sorted(before)
            root = components_of([five_words(before[i]) for i in ids], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
            assert sorted(r.doc_id for r in rows) == sorted({ids[r] for r in root})
        if name == "mixing":
            assert all(r.text == before[r.doc_id] for r in rows) and max(Counter(r.doc_id for r in rows).values()) <= 2
        docs = out
