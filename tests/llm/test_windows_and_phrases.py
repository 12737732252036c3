"""op11 to op13 and the near-copy stage against brute force, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import blocks, collocations, near_copies, queries, spelling, substring_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = r"[^\x20\x09-\x0D]+"
CLASH = ("row", "key", "rid", "spans", "bucket", "blob", "shard", "size", "phrase", "n", "word", "form", "label")


def docs_of(spark, rows):
    wide = spark.createDataFrame([(*r, None, 0) for r in rows], DOCS)
    for name in CLASH:
        wide = wide.withColumn(name, F.lit("clash"))
    return wide


def prose(rng, n, vocabulary=60):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


def odd_rows():
    rng = np.random.default_rng(3)
    passage = prose(rng, 45, 9000)
    rows = [(i, " ".join(prose(rng, 30, 9000) + passage + prose(rng, 30, 9000)), "en") for i in range(0, 60, 2)]
    rows += [(i, "\n".join(prose(rng, 40)), "de") for i in range(100, 130)]
    rows += [(200, " ".join(passage * 3), None), (201, "x " * 300, "und"), (202, None, "en"), (203, "", "en"), (204, "\x0b\x0c \t", None)]
    rows += [(205, rows[0][1], "en"), (205, rows[0][1], "en"), (205, " ".join(passage[:25]), "de"), (None, rows[0][1], "en"), (-7, rows[0][1], "en")]
    rows += [(206, "été 中文 𝒳 " * 30, "fr"), (207, "a\tb  c\r\n" * 50, "fr"), (208, "A b. a B! a,b a b;" * 20, "fr")]
    return rows


# op13 -------------------------------------------------------------------------------------------


def removed_by_hand(rows, width=20):
    """(doc_id, words, removed, sha) of every row; rows of one id are ordered by the hash of their text, equal rows are one."""
    import xxhash

    rid = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63 else 0)
    first = {}
    for i, r, t in sorted({(i, rid(t), t or "") for i, t, _ in rows if i is not None}):
        words = re.findall(WORD, t)
        for at in range(len(words) - width + 1):
            first.setdefault(tuple(words[at : at + width]), (i, r, at))
    out = []
    for i, t, _ in rows:
        words = re.findall(WORD, t or "")
        gone = set()
        for at in range(len(words) - width + 1):
            if i is not None and first[tuple(words[at : at + width])] != (i, rid(t), at):
                gone.update(range(at, at + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,heavy", [(1 << 20, 1000), (600, 2)])
def test_substring_dedup(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rows = odd_rows()
    got = substring_dedup.dedup_substrings(docs_of(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == removed_by_hand(rows)
    assert max(r.n_removed for r in got) > 200


def test_substring_spans_and_empty(spark):
    docs = docs_of(spark, [(1, "a b c d e f", None), (2, "x a b c d y", None)])
    found = {r.row.doc_id: r.spans for r in substring_dedup.with_spans(docs, width=4, gram=2).collect()}
    assert found[1] is None and [tuple(s) for s in found[2]] == [(1, 5)]
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_windows_of_one_hash_are_told_apart_by_their_words():
    codes = np.array([1, 2, 3, 9, 4, 5, 6, 9, 1, 2, 3, 9, 4, 5, 6])
    starts = np.array([0, 4, 8, 12])
    order, same = substring_dedup.repeats_of(codes, np.zeros(4, np.uint64), starts, 3)
    assert {tuple(sorted((int(order[i - 1]), int(order[i])))) for i in np.flatnonzero(same)} == {(0, 2), (1, 3)}


# op12 -------------------------------------------------------------------------------------------


def phrases_by_hand(rows, least, per_lang):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in frequent.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            covered = any(100 * b >= 50 * a for q, b in frequent.items() if len(q) > len(p) and p in (q[:2], q[1:]))
            if not covered:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("block,shards,per_lang", [(1 << 20, 4, 2000), (500, 1, 2000), (500, 10, 7)])
def test_collocations(spark, monkeypatch, block, shards, per_lang):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    rows = odd_rows()
    got = collocations.collocations(docs_of(spark, rows).repartition(5), per_lang=per_lang, shards=shards)
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_hand(rows, 10, per_lang)
    assert collocations.collocations(docs_of(spark, rows).limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    big = 3 * 10**12
    counts = spark.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], collocations.COUNTED)
    row = collocations.scored(counts).first()
    assert row.score == 10**6 * big * big // ((big + 7) * (big + 1))


# op11 -------------------------------------------------------------------------------------------


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_by_hand(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def spelling_rows():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(60)]
    rows += [(1000 + k, f"{w} " * times, "en") for k, (w, times) in enumerate([("banana", 700), ("Bananb", 130), ("bananbb", 25), ("bananbbb", 5), ("aaaaaa", 9), ("aaaaaaa", 50)])]
    rows += [(None, "ÀÿÀÿÀÿ÷× " * 6, None), (7, None, None), (7, "", None), (8, "z" * 5000, "en"), (8, ("z" * 5000 + " ") * 6, "en")]
    return rows + rows[:3]


@pytest.mark.parametrize("most,prune", [(1000, 100), (3, 100), (1000, 0), (20, 10**6)])
def test_spelling_groups(spark, monkeypatch, most, prune):
    monkeypatch.setattr(spelling.frequent_grams, "__defaults__", (spelling.SHORT, spelling.LONG, prune))
    rows = spelling_rows()
    got = spelling.spelling_groups(docs_of(spark, rows), most=most).select("word", "form", "root", "n", "n_near", "form_n")
    expected = groups_by_hand(rows)
    assert sorted(tuple(r) for r in got.collect()) == expected
    assert any(root not in (w, form) for w, form, root, *_ in expected if form)
    assert spelling.spelling_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_affected_gram_bound_holds():
    """No edit changes more grams than the bound, whatever the dictionary."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        word = "".join(rng.choice(list("ab"), rng.integers(6, 10)))
        frequent = {g for g in (a + b for a in "ab" for b in "ab")} if rng.random() < 0.5 else {"ab", "ba"}
        frequent |= {g + c for g in frequent for c in "ab" if rng.random() < 0.5}
        grams, bound = spelling.decomposed(word, frequent)
        assert len(grams) == len(word) - 1 and bound < len(grams)
        at = int(rng.integers(0, len(word)))
        for other in (word[:at] + word[at + 1 :], word[:at] + "c" + word[at + 1 :], word[:at] + "c" + word[at:], word + "a", word + "b"):
            shared = sum((Counter(grams) & Counter(spelling.decomposed(other, frequent)[0])).values())
            assert shared >= len(grams) - bound


# near copies ------------------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if width else frozenset()


def copies_by_hand(rows):
    ids = sorted(i for i, _, _ in rows)
    sets = {i: shingle_set(t) for i, t, _ in rows}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (sets[i] == sets[j] or (sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family_rows():
    """Pairs between 0.8 and 1, a pair just below, a family around one text whose members are no copies of its smallest, a common passage."""
    rng = np.random.default_rng(11)
    rows, base = [], prose(rng, 100, 9000)
    for i, edits in enumerate([0, 1, 1, 2, 2, 3]):
        words = list(base)
        for k in range(edits):
            words[(17 + 31 * k) % 100] = f"edit{i}-{k}"
        rows.append((i, " ".join(words), "en"))
    family = prose(rng, 120, 9000)
    for i in range(100, 220):
        words = list(family)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            words[at] = f"own{i}-{at}"
        rows.append((i, " ".join(words), "en"))
    passage = prose(rng, 60, 9000)
    rows += [(i, " ".join(passage + prose(rng, int(rng.integers(10, 40)), 9000)), "en") for i in range(300, 420)]
    rows += [(500, None, None), (501, "", None), (502, "Two words", None), (503, "two  WORDS", None)]
    return rows


@pytest.mark.parametrize("group", [4096, 8])
def test_near_copies_by_exact_similarity(spark, monkeypatch, group):
    monkeypatch.setattr(near_copies, "GROUP", group)
    rows = family_rows()
    sets = [shingle_set(t) for _, t, _ in rows]
    close = [len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a and b]
    assert any(0.8 <= s < 0.9 for s in close) and any(0.75 < s < 0.8 for s in close)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs_of(spark, rows)).collect()}
    assert got == copies_by_hand(rows)


def test_components_grow_inside_a_key():
    rng = np.random.default_rng(2)
    base = np.arange(100)
    sets = [np.unique(np.where(rng.random(100) < p, rng.integers(1000, 10**6, 100), base)).astype(np.uint64) for p in rng.choice([0, 0.04, 0.08, 0.5], 80)]
    labels = np.arange(80) // 2
    near_copies_of = lambda x, y: near_copies.similar(x, y)
    up = list(range(40))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(80):
        for j in range(i):
            if near_copies_of(sets[i], sets[j]):
                a, b = sorted((find(labels[i]), find(labels[j])))
                up[b] = a
    expected = [find(k) for k in range(40)]
    up = list(range(40))
    for x, y in near_copies.grown(sets, labels):
        assert near_copies_of(sets[x], sets[y])
        a, b = sorted((find(labels[x]), find(labels[y])))
        up[b] = a
    assert [find(k) for k in range(40)] == expected and len(set(expected)) > 3


def test_minhash_recall_at_the_threshold():
    """Pairs of similarity 0.8 that share a key, over many random sets: expected 0.99993, required 0.99."""
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(400):
        both, own = rng.integers(0, 2**63, 160).astype(np.uint64), rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = np.unique(np.concatenate([both, own[:20]])), np.unique(np.concatenate([both, own[20:]]))
        met += bool((near_copies.band_keys(a) == near_copies.band_keys(b)).any())
    assert met / 400 >= 0.99


# blocks -----------------------------------------------------------------------------------------


def test_words_of_blocks():
    texts = ["a bc  a", None, "", "\t", "Ünï cödé", "x\ny"]
    words = blocks.find_words(pa.array(texts))
    names = words.names.to_pylist()
    got = [[names[c] for c in words.codes[words.first[i] : words.first[i + 1]]] for i in range(len(texts))]
    assert got == [re.findall(WORD, t or "") for t in texts]
    assert blocks.find_words(pa.array([], pa.string())).names.to_pylist() == []


def test_filter_keeps_every_frequent_key(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    parts = [(s, np.unique(rng.choice(keys[:3000], 2000))) for s in (0, 0, 1, 1, 1)]
    rows = [(b, s, blob) for s, part in parts for b, blob in blocks.key_blobs(part, np.ones(len(part), np.int64), 64)]
    frame = spark.createDataFrame(rows, "bucket bigint, shard int, blob binary")
    may, _ = blocks.frequent_keys(frame, 2, 64)
    counts = {s: Counter(k for t, part in parts if t == s for k in part.tolist()) for s in (0, 1)}
    frequent = {k for c in counts.values() for k, n in c.items() if n >= 2}
    held = set(keys[may.may_hold(keys)].tolist())
    assert frequent <= held and len(held - frequent) < 20


# SQL --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_collocations", "op13_substring_dedup"])
def test_queries_equal_their_sql(spark, sf, name):
    found, sql = queries.registered()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = db.sql(sql[name])
    got = found[name](spark, sf).select(*expected.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected.fetchall()) != []


def test_near_copies_come_from_simhash_balls(spark):
    """Pairs within the SimHash radius are proposed even where no MinHash key is shared; the exact sets still decide."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(0, 40, 2):
        words = prose(rng, 400, 9000)
        other = list(words)
        other[200] = f"own{i}"
        rows += [(i, " ".join(words), "en"), (i + 1, " ".join(other), "en")]
    rows += [(100, "", None), (101, " ".join(prose(rng, 30, 9000)), None)]
    sets = [near_copies.shingles(t) for _, t, _ in rows]
    assert near_copies.bits(sets[-2]) == 0
    for s in sets[:4]:
        assert near_copies.bits(s) & (2**64 - 1) == sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in s) * 2 > len(s))
    close = {i for i in range(0, 40, 2) if ((near_copies.bits(sets[i]) ^ near_copies.bits(sets[i + 1])) & (2**64 - 1)).bit_count() <= 4}
    assert len(close) > 10
    keys = iter(range(10**9))  # no two sets share a key
    nodes = [(near_copies.digest(s), rows[i][0], len(s), near_copies.bits(s), [next(keys) for _ in range(near_copies.BANDS)]) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(nodes, "fp bigint, first bigint, n bigint, bits bigint, bands array<bigint>")
    name = {near_copies.digest(s): rows[i][0] for i, s in enumerate(sets)}
    found = {tuple(sorted((name[r.a], name[r.b]))) for r in near_copies.links(nodes, docs_of(spark, rows)).collect()}
    assert found == {(i, i + 1) for i in close}
