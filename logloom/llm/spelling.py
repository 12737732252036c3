"""Spelling variant grouping over a variable-length gram index.

Words and their counts come from blocks of documents.  Grams have ``SHORT`` to ``LONG`` characters:
the dictionary keeps a gram's extensions only if the gram is frequent (over ``PRUNE`` words), so
common starts are indexed by longer grams and rare ones by short grams.  A word has one gram a
place, the longest that the dictionary knows there.

One edit changes few of them: a gram to the right of it stays, and one to the left only changes if
the dictionary could extend it up to the edit.  The largest number over all places of an edit is
the word's affected-gram bound b; of its g grams any near word has g - b or more.  Hence two near
words share a gram among the b + 1 rarest of each, and only those lists are merged; pairs whose
lengths differ by one at most are verified by their edit distance.  A word of ``SHORT +
LONG`` characters has more grams than its bound, so nothing is left out.

A list longer than ``MOST`` is not merged pair by pair: its words are matched by their variants
with one character left out, where equal variants are near words already (or, from both ends of an
insertion, the word itself).  That way is exact too and linear.

Defined cases: a null text has no words; a null ``doc_id`` counts as an empty id in the checksum;
repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import byte_set, find_words, text_blocks
from .common import staged

MIN_CHARS, MIN_COUNT, RATIO, DIVISOR = 6, 5, 5, 199
SHORT, LONG, PRUNE, MOST = 2, 4, 100, 1000
#: Symbols that words are made of, a-z and U+00C0 to U+00FF: there are at most 90**2 + 90**3 grams below LONG.
ALPHABET = 26 + 64
#: Steps along forms grow counts RATIO times, from MIN_COUNT up to 2**63 at most: under 2**DOUBLINGS steps.
DOUBLINGS = 5
_LETTERS = byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which is 0xC3 and the byte after it."""
    lead = data == 0xC3
    out = _LETTERS[data] | lead
    out[1:] |= lead[:-1]
    return out


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of the documents and how often they occur, after the deletions."""
    words = find_words(batch.column("text"), letters, lower=True)
    names = words.names.to_pylist()
    raw = [x.encode() for x in names]
    doc, code = np.divmod(np.sort(words.text_of() * max(1, len(names)) + words.codes), max(1, len(names)))
    fresh = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    n = np.diff(fresh, append=len(doc))
    doc, code = doc[fresh], code[fresh]
    ids = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
    heads = [zlib.crc32(f"{i}:".encode()) for i in ids]
    sums = np.fromiter((zlib.crc32(raw[c], heads[d]) for d, c in zip(doc.tolist(), code.tolist(), strict=True)), np.uint32, len(doc))
    cut = sums % DIVISOR == 0
    total = np.bincount(code[~cut], n[~cut], len(names)).astype(np.int64)
    yield names, total
    changed = []
    for c, h in zip(code[cut].tolist(), sums[cut].tolist(), strict=True):
        name = names[c]
        at = h % len(name)
        changed.append(name[:at] + name[at + 1 :])
    yield changed, n[cut].astype(np.int64)


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words with so many characters and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            for names, n in runs_of(batch):
                words = pa.array(names, pa.string())
                takes = pc.and_(pc.greater_equal(pc.utf8_length(words), min_chars), pc.greater(pa.array(n), 0))
                yield pa.record_batch([words.filter(takes), pa.array(n).filter(takes)], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, short: int = SHORT, long: int = LONG, prune: int = PRUNE) -> DataFrame:
    """The grams that the dictionary extends."""
    found = []
    for size in range(short, long):
        at = F.sequence(F.lit(1), F.char_length("word") - size + 1)
        gram = F.explode(F.transform(at, lambda i, size=size: F.substring(F.col("word"), i, F.lit(size))))
        found.append(words.where(F.char_length("word") >= size).select(gram.alias("gram")))
    grams = found[0]
    for more in found[1:]:
        grams = grams.unionAll(more)
    return grams.groupBy("gram").count().where(F.col("count") > prune).select("gram")


def decomposed(word: str, frequent: set[str], short: int = SHORT, long: int = LONG) -> tuple[list[str], int]:
    """The word's gram at each place, and how many of them one edit can affect at most."""
    size = len(word)
    grams, reach = [], []
    for a in range(size - short + 1):
        n = short
        while n < long and a + n < size and word[a : a + n] in frequent:
            n += 1
        grams.append(word[a : a + n])
        # A longer gram could start here as long as the next character is not this one.
        reach.append(n if word[a : a + n] in frequent and n < long else n - 1)
    bound = 0
    for edit in range(size + 1):
        # Up to the edit the dictionary goes on: the gram covers it, or would if the next character were another.
        bound = max(bound, sum(1 for a in range(max(0, edit - long + 1), min(edit, len(grams) - 1) + 1) if a + reach[a] >= edit))
    return grams, bound


def index_entries(words: DataFrame, frequent: Iterable[str], short: int = SHORT, long: int = LONG) -> DataFrame:
    """word, n, size, token: the b + 1 rarest grams of each word; a token is a gram and its number in the word."""
    known = words.sparkSession.sparkContext.broadcast(frozenset(frequent))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for word in part["word"]:
                grams, bound = decomposed(word, known.value, short, long)
                seen: dict[str, int] = {}
                tokens = []
                for gram in grams:
                    seen[gram] = seen.get(gram, 0) + 1
                    tokens.append(f"{gram}{seen[gram]}")
                rows.append((tokens, bound))
            yield pd.DataFrame({"word": part["word"], "n": part["n"], "tokens": [r[0] for r in rows], "bound": [r[1] for r in rows]})

    cuts = words.mapInPandas(cut, "word string, n bigint, tokens array<string>, bound int")
    flat = staged(cuts.select("word", "n", "bound", F.explode("tokens").alias("token")), "grams")
    lists = flat.groupBy("token").agg(F.count("*").alias("words"))
    sorted_grams = F.sort_array(F.collect_list(F.struct("words", "token")))
    rarest = flat.join(lists.hint("merge"), "token").groupBy("word", "n", "bound").agg(sorted_grams.alias("grams"))
    taken = rarest.select("word", "n", F.explode(F.slice("grams", F.lit(1), F.col("bound") + 1)).alias("g"))
    return taken.select("word", "n", F.char_length("word").alias("size"), "g.token")


PAIR = ["a", "a_n", "b", "b_n"]


def merged_lists(entries: DataFrame, most: int = MOST) -> DataFrame:
    """a, a_n, b, b_n: near words a < b, each pair once; entries as of ``index_entries``."""
    lists = staged(entries.groupBy("token").agg(F.count("*").alias("words")).where("words > 1"), "lists")
    short = entries.join(lists.where(F.col("words") <= most).hint("merge"), "token")
    side = lambda s: short.select("token", *[F.col(c).alias(f"{s}_{c}" if c != "word" else s) for c in ("word", "n", "size")])
    within = (F.col("a") < F.col("b")) & (F.abs(F.col("a_size") - F.col("b_size")) <= 1)
    pairs = side("a").join(side("b").hint("merge"), "token").where(within).where(F.levenshtein("a", "b", 1) == 1).select(*PAIR)
    # The words of the long lists, matched without listing pairs that are not near.
    crowded = entries.join(lists.where(F.col("words") > most).hint("merge"), "token", "left_semi").select("word", "n", "size").distinct()
    at = F.explode(F.sequence(F.lit(0), F.col("size"))).alias("at")
    left_out = F.concat(F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)"))
    # Place 0 is the word itself.
    variants = crowded.select("word", "n", at).select("word", "n", "at", F.when(F.col("at") == 0, F.col("word")).otherwise(left_out).alias("variant"))
    replaced = variants.where("at > 0")
    name = lambda df, s, *more: df.select("variant", *more, F.col("word").alias(s), F.col("n").alias(f"{s}_n"))
    same_place = name(replaced, "a", "at").join(name(replaced, "b", "at").hint("merge"), ["variant", "at"]).where("a < b").select(*PAIR)
    inserted = name(variants.where("at = 0"), "a").join(name(replaced, "b").hint("merge"), "variant").select(*PAIR)
    first = F.col("a") < F.col("b")
    inserted = inserted.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip(PAIR, [*PAIR[2:], *PAIR[:2]], strict=True)])
    return pairs.unionAll(same_place).unionAll(inserted).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, form) -> word, root: the end of each chain, by doubling the steps."""
    jumps = staged(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(DOUBLINGS):
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = staged(jumps.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return jumps


def spelling_groups(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    if min_chars < SHORT + LONG:
        raise ValueError(f"words of under {SHORT + LONG} characters can lose all their grams to one edit")
    words = staged(word_counts(docs, min_chars, min_count), "words")
    frequent = [r["gram"] for r in frequent_grams(words).collect()]  # at most ALPHABET**2 + ALPHABET**3
    pairs = staged(merged_lists(staged(index_entries(words, frequent), "entries"), most), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    # The largest count, then the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rated = words.join(near.hint("merge"), "word", "left")
    # Counts times the ratio could pass 64 bits.
    leads = -F.col("best.minus") >= F.col("n").cast("decimal(38,0)") * ratio
    rated = rated.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(leads, F.col("best")).alias("lead"))
    rated = staged(rated.select("word", "n", "n_near", F.col("lead.near").alias("form"), (-F.col("lead.minus")).alias("form_n")), "rated")
    roots = roots_of(rated.where("form is not null"))
    return rated.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
