"""Language ID: piece unigrams with every segmentation summed.

A word, with a mark for its start, may be cut into pieces of a fixed public vocabulary in many
ways.  A language gives each piece a probability; the probability of a word is the sum over all
its segmentations of the products of their pieces, computed by a forward pass.  Piece probabilities
are fitted per language by expectation maximisation over the same sums (forward and backward).

Training reads at most ``SAMPLE`` documents per language (by a hash of the id, whole texts) as
counts of distinct words, one language a task; scoring is one narrow pass.  Words longer than
``LONGEST`` characters are read as consecutive stretches of that length.  A character that no piece
covers is a piece of its own kind (``UNKNOWN``).

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null language
teaches nothing; with nothing learned every text is ``und``; equal scores go to the language that
sorts first; repeated rows are scored alike; other columns are carried unread.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_training

SAMPLE, ROUNDS, LONGEST, REMEMBERED = 600, 4, 40, 300_000
START = "▁"
LETTER = regex.compile(r"\p{L}")
UNSEEN, FLOOR = 50.0, 1e-9
#: Odd multipliers of the rolling hash that looks pieces up.
CODE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def public_vocabulary(path: str | None = None) -> list[str]:
    """The printable pieces of a public sentencepiece vocabulary."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def stretches(word: str) -> list[str]:
    word = START + word
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def counted(text: str) -> Counter:
    """How often the text holds each stretch."""
    words = Counter(text.split())
    out = Counter({START + w: n for w, n in words.items() if len(w) < LONGEST})
    for w, n in words.items():
        if len(w) >= LONGEST:
            for part in stretches(w):
                out[part] += n
    return out


class Lattice:
    """All pieces of many words of one length, as arrays: piece ids by (word, end, piece length)."""

    def __init__(self, index: dict[str, int]):
        self.unknown = len(index)
        # Per piece length the sorted 64-bit hashes of the pieces, and their ids.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size = defaultdict(list)
        for piece in index:
            by_size[len(piece)].append(piece)
        for size, pieces in by_size.items():
            hashes = self._hashes(pieces, size)[:, 0]
            order = np.argsort(hashes)
            self.tables[size] = hashes[order], np.array([index[p] for p in pieces], np.int32)[order]
        self.most = max(by_size, default=1)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        return flat.reshape(len(words), -1).astype(np.uint64) * CODE + CODE

    def _hashes(self, words: list[str], size: int) -> np.ndarray:
        codes = self._codes(words)
        out = np.zeros_like(codes)
        for k in range(size):
            out = out[:, : codes.shape[1] - k] * STEP + codes[:, k:]
        return out

    def pieces(self, words: list[str]) -> np.ndarray:
        codes = self._codes(words)
        n = codes.shape[1]
        most = min(n, self.most)
        ids = np.full((len(words), n + 1, most + 1), -1, np.int32)
        hashes = np.zeros_like(codes)
        for size in range(1, most + 1):
            hashes = hashes[:, : n - size + 1] * STEP + codes[:, size - 1 :]
            if size in self.tables:
                known, names = self.tables[size]
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                ids[:, size:, size] = np.where(known[at] == hashes, names[at], -1)
        single = ids[:, 1:, 1]
        single[single < 0] = self.unknown
        return ids

    @staticmethod
    def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """alpha[word, end, language] under prob[piece or -1, language]."""
        words, ends, sizes = ids.shape
        alpha = np.zeros((words, ends, prob.shape[1]))
        alpha[:, 0] = 1.0
        for end in range(1, ends):
            for size in range(1, min(end, sizes - 1) + 1):
                alpha[:, end] += alpha[:, end - size] * prob[ids[:, end, size]]
        return alpha


def _by_length(words: list[str], block: int = 4000) -> Iterator[list[int]]:
    groups = defaultdict(list)
    for i, word in enumerate(words):
        groups[len(word)].append(i)
    for group in groups.values():
        for at in range(0, len(group), block):
            yield group[at : at + block]


def fit_pieces(counts: dict[str, int], index: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Expected counts of each piece (last: unknown characters) after ``rounds`` of EM."""
    lattice, words = Lattice(index), list(counts)
    n = len(index) + 1
    blocks = [(lattice.pieces([words[i] for i in at]), np.array([counts[words[i]] for i in at], float)) for at in _by_length(words)]
    prob = np.full(n, 1.0 / n)
    expected = np.zeros(n)
    for _ in range(rounds):
        expected = np.zeros(n)
        padded = np.append(prob, 0.0)[:, None]  # -1: no piece
        for ids, weight in blocks:
            alpha = Lattice.forward(ids, padded)[:, :, 0]
            total = alpha[:, -1]
            beta = np.zeros_like(alpha)
            beta[:, -1] = 1.0
            for start in range(ids.shape[1] - 2, -1, -1):
                for size in range(1, min(ids.shape[2] - 1, ids.shape[1] - 1 - start) + 1):
                    beta[:, start] += beta[:, start + size] * padded[ids[:, start + size, size], 0]
            share = weight / np.maximum(total, 1e-290)
            for end in range(1, ids.shape[1]):
                for size in range(1, min(end, ids.shape[2] - 1) + 1):
                    piece = ids[:, end, size]
                    used = piece >= 0
                    if used.any():
                        gain = alpha[used, end - size] * padded[piece[used], 0] * beta[used, end] * share[used]
                        expected += np.bincount(piece[used], gain, n)
        prob = (expected + FLOOR) / (expected.sum() + FLOOR * n)
    return expected


def train(docs: DataFrame, vocabulary: list[str], sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and prob[piece or unknown, language].  The result has vocabulary x languages numbers."""
    known = docs.where("text is not null and lang is not null").where(in_training(F.col("doc_id"))).select("lang", "text", "doc_id")
    turn = F.xxhash64(F.lit(78), "doc_id")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return [], np.zeros((len(vocabulary) + 1, 0))
    # Thin by hash to about twice the sample first, so that ranking sees few rows of a large language.
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, 2**63 - 1 if n <= 2 * sample else 2 * sample * 2**63 // n)])
    thin = known.where(turn.bitwiseAND(F.lit(2**63 - 1)) <= bound[F.col("lang")])
    ranked = thin.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(turn, "doc_id", "text"))).where(F.col("_rank") <= sample)
    index = {p: i for i, p in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast(index)  # a fixed public vocabulary

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        counts = Counter()
        for text in group["text"]:
            counts.update(counted(text))
        got = fit_pieces(counts, shared.value)
        used = np.flatnonzero(got > 0)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "piece": used, "n": got[used]})

    fitted = ranked.select("lang", "text").groupBy("lang").applyInPandas(learn, "lang string, piece int, n double").toPandas()
    langs = sorted(sizes)
    n = np.zeros((len(vocabulary) + 1, len(langs)))
    n[fitted["piece"].to_numpy(), fitted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = fitted["n"].to_numpy()
    total = n.sum(axis=1) + 1.0
    prior = total / total.sum()
    return langs, (n + UNSEEN * prior[:, None]) / (n.sum(axis=0) + UNSEEN)


class Reader:
    """Scores texts; remembers the log probabilities of distinct words, a bounded number of them."""

    def __init__(self, index: dict[str, int], prob: np.ndarray):
        self.lattice, self.prob = Lattice(index), np.vstack([prob, np.zeros(prob.shape[1])])
        self.known: dict[str, int] = {}
        self.logs = np.empty((0, prob.shape[1]))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.logs, new = {}, self.logs[:0], list(words)
        parts = [self.logs]
        for at in _by_length(new):
            group = [new[i] for i in at]
            parts.append(np.log(np.maximum(Lattice.forward(self.lattice.pieces(group), self.prob)[:, -1], 1e-300)))
            self.known.update(zip(group, range(len(self.known), len(self.known) + len(group)), strict=True))
        self.logs = np.concatenate(parts)

    def read(self, texts: list[str]) -> list[np.ndarray]:
        counts = [counted(t) for t in texts]
        self.learn(set().union(*counts))
        row = self.known.__getitem__
        return [np.array(list(c.values()), float) @ self.logs[list(map(row, c))] for c in counts]


def identify(docs: DataFrame, langs: list[str], prob: np.ndarray, vocabulary: list[str]) -> DataFrame:
    """``row`` (all columns of docs), lang_pred and score: the winner's share of the summed likelihoods."""
    model = docs.sparkSession.sparkContext.broadcast(({p: i for i, p in enumerate(vocabulary)}, prob))  # vocabulary x languages

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(*model.value)
        for texts in batches:
            out = []
            chunk, size = [], 0
            for t in texts:
                chunk.append(t if t is not None and LETTER.search(t) else None)
                size += len(chunk[-1] or "")
                if size > 2_000_000:
                    out += _guess(reader, langs, chunk)
                    chunk, size = [], 0
            out += _guess(reader, langs, chunk)
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    rated = docs.select(F.struct(*docs.columns).alias("row"), guess(F.col("text")).alias("rated"))
    return rated.select("row", "rated.lang_pred", "rated.score")


def _guess(reader: Reader, langs: list[str], texts: list[str | None]) -> list[tuple[str, float]]:
    logs = iter(reader.read([t for t in texts if t is not None]) if langs else ())
    out = []
    for t in texts:
        if t is None or not langs:
            out.append(("und", 0.0))
            continue
        scores = next(logs)
        best = int(np.argmax(scores))
        out.append((langs[best], float(1 / np.exp(scores - scores[best]).sum())))
    return out
