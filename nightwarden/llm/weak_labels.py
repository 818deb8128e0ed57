"""A quality classifier without labels: heuristic votes, their accuracies, a hashed scorer.

1. Overlapping heuristics vote good, bad or nothing on every document.
2. Documents with the same votes count together, so the whole corpus becomes a histogram of
   at most 3 ** 8 rows. Expectation-maximisation over it estimates how often each heuristic
   votes what on good and on bad documents, and the posterior of every vote pattern.
3. A bounded sample of documents (`MAX_TRAIN`, those with the smallest hash) with posteriors as
   soft labels trains a linear scorer over hashed words and word shapes.
4. The scorer runs over every whole text; it needs no votes, so it also judges where
   heuristics stay silent.

Defined cases: a NULL text is empty; a text without words scores 0 and is not kept; every row
gives one row, repeated rows and NULL ids included; other columns are not read; an empty
table gives an empty result. Where all patterns agree, all documents get that label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from nightwarden.session import checkpointed

GOOD, BAD, NONE = 1, 0, 2
HEURISTICS = ("length", "symbols", "capitals", "exclamations", "variety", "word_length", "sentences", "lines")
#: Documents that train the scorer at most, hashed features, and documents read at a time.
MAX_TRAIN, FEATURES, TEXTS = 6000, 1 << 18, 256
UPPER, LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))
SYMBOLS = b"#*$%&|<>{}~^"


def votes(text: str) -> int:
    """The votes of all heuristics as one number, base 3 in the order of HEURISTICS.

    Most of them know one kind of fault and are silent otherwise; variety and sentences also vote good.
    """
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)

    def bad(value: float, total: float, limit: float, least: int = 1) -> int:
        return BAD if total >= least and value > limit * total else NONE

    def count(chars: bytes) -> int:
        return size - len(data.translate(None, chars))

    letters, ends = count(LETTERS), sum(w[-1] in b".?!;:" for w in words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    mean = sum(map(len, words)) / n if n else 0
    kinds = len(set(words))
    cast = (
        BAD if n < 4 else NONE,
        bad(count(SYMBOLS), n, 0.2),
        bad(count(UPPER), letters, 0.5, 20),
        bad(data.count(b"!"), n, 0.2),
        NONE if n < 10 else GOOD if kinds >= 0.25 * n else BAD if kinds < 0.1 * n else NONE,
        BAD if n and not 2 <= mean <= 20 else NONE,
        NONE if n < 20 else GOOD if 0.02 * n <= ends <= 0.4 * n else BAD if ends > 0.7 * n or not ends else NONE,
        bad(len(lines) - len(set(lines)), len(lines), 0.5, 4),
    )
    return sum(v * 3 ** i for i, v in enumerate(cast))


@dataclass
class LabelModel:
    """What heuristics vote on bad and good documents, and the posterior of each pattern."""

    chances: np.ndarray  # (class, heuristic, vote)
    posterior: dict[int, float]


#: What heuristics are taken for before any count, as chances of bad, good and no vote, and how
#: many votes that is worth, as a share of the corpus. Without it the two classes may settle on
#: any other contrast in the corpus, such as short and long.
ASSUMED = np.array([[0.3, 0.1, 0.6], [0.002, 0.398, 0.6]])
TRUST, BALANCE = 1.0, 0.5


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over the histogram of vote patterns.

    A document counts as good or bad at even odds before its votes (`BALANCE`), so that a rare
    fault is judged by its votes and not by its rarity; a heuristic that is silent says nothing.
    """
    cast = unpacked(patterns)
    chances = np.repeat(ASSUMED[:, None, :], len(HEURISTICS), 1)
    belief = np.full(len(patterns), np.nan)
    for _ in range(rounds):
        scores = (np.log(chances)[:, np.arange(len(HEURISTICS)), cast] * (cast != NONE)).sum(2)
        margin = scores[1] - scores[0] + math.log(BALANCE / (1 - BALANCE))
        new = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        done, belief = np.abs(new - belief).max(initial=0) < 1e-9, new
        if done:
            break
        weight = np.stack([counts * (1 - belief), counts * belief])
        chances = np.stack([weight @ (cast == vote) for vote in range(3)], 2) + TRUST * counts.sum() * ASSUMED[:, None, :]
        chances /= chances.sum(2, keepdims=True)
    return LabelModel(chances, dict(zip(patterns.tolist(), belief.tolist())))


_SHAPES = ((re.compile("[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile("[a-zß-öø-ÿ]+"), "x"), (re.compile("[0-9]+"), "9"))


def word_features(word: str) -> tuple[int, int]:
    shape = word[:64]
    for pattern, to in _SHAPES:
        shape = pattern.sub(to, shape)
    return (xxhash.xxh64_intdigest("w" + word.lower()) % FEATURES, xxhash.xxh64_intdigest("s" + shape) % FEATURES)


#: The feature whose value is the share of words that repeat the word before them.
REPEATS = xxhash.xxh64_intdigest("repeats") % FEATURES


def repeats(words: list[str]) -> float:
    return sum(map(eq, words, words[1:])) / len(words) if words else 0.0


class Words(dict):
    """Value per word, computed once; emptied before it grows beyond bounds."""

    def __init__(self, value, most: int = 500_000):
        super().__init__()
        self.value, self.most = value, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        found = self.value(word)
        if len(word) <= 64:
            self[word] = found
        return found


_WORD = re.compile("[^ \t-\r]+")


@dataclass
class Scorer:
    """Logistic regression on the mean feature vector of a text's words and their repeats."""

    weights: np.ndarray
    bias: float

    def word_values(self) -> Words:
        return Words(lambda w: float(sum(self.weights[i] for i in word_features(w))))

    def score(self, text: str, values: Words) -> float:
        words = _WORD.findall(text)
        if not words:
            return 0.0
        margin = self.bias + math.fsum(map(values.__getitem__, words)) / len(words) + float(self.weights[REPEATS]) * repeats(words)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, margin))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300, rate: float = 1.0, l2: float = 1e-7) -> Scorer:
    """AdaGrad over (features, mean counts, soft label) rows."""
    weights, bias = np.zeros(FEATURES), 0.0
    if rows:
        size = np.array([len(f) for f, _, _ in rows])
        at, row = np.concatenate([f for f, _, _ in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), size)
        value, label = np.concatenate([v for _, v, _ in rows]), np.array([y for _, _, y in rows])
        good = min(max(label.mean(), 1e-3), 1 - 1e-3)
        share = np.where(label >= 0.5, 0.5 / good, 0.5 / (1 - good))  # both labels weigh the same
        squares, bias_squares = np.full(FEATURES, 1e-10), 1e-10
        for _ in range(rounds):
            margin = bias + np.bincount(row, weights[at] * value, len(rows))
            error = share * (label - 1 / (1 + np.exp(-np.clip(margin, -50, 50))))
            grad = np.bincount(at, value * error[row], FEATURES) / len(rows) - l2 * weights
            squares += grad * grad
            weights += rate * grad / np.sqrt(squares)
            bias_squares += error.mean() ** 2
            bias += rate * error.mean() / math.sqrt(bias_squares)
    return Scorer(weights.astype(np.float32), bias)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            rows = batch.slice(k, TEXTS)
            yield rows, [t or "" for t in rows.column(column).to_pylist()]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in _texts(batches, 2):
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([votes(t) for t in texts], pa.int32())],
                                         names=["doc_id", "hash", "pattern"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Words(word_features)
    for rows, texts in _texts(batches, 1):
        at, value = [], []
        for text in texts:
            words = _WORD.findall(text)
            found, times = np.unique(np.array([i for w in words for i in features[w]], np.int64), return_counts=True)
            at.append(np.append(found, REPEATS))
            value.append(np.append(times / max(1, len(words)), repeats(words)))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(at, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64()))],
                                         names=["hash", "features", "counts"])


def classified(docs: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, posterior, score, kept) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("hash"), "text")
    voted = checkpointed(rows.mapInArrow(_vote, "doc_id long, hash long, pattern int"))
    histogram = voted.groupBy("pattern").count().orderBy("pattern").toPandas()  # at most 3 ** 8 rows
    labels = fit_labels(histogram["pattern"].to_numpy(np.int64), histogram["count"].to_numpy(float))
    chosen = voted.select("hash", "pattern").distinct().orderBy("hash", "pattern").limit(max_train).collect()
    patterns = {r["hash"]: r["pattern"] for r in chosen}
    sample = rows.filter(F.col("hash") <= max(patterns, default=-(1 << 63))).select("hash", "text").mapInArrow(
        _count, "hash long, features array<long>, counts array<double>").dropDuplicates(["hash"]).orderBy("hash").toPandas()
    scorer = fit_scorer([(r.features, r.counts, labels.posterior[patterns[r.hash]]) for r in sample.itertuples() if r.hash in patterns])
    posterior = labels.posterior

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = scorer.word_values()
        for part, texts in _texts(batches, 1):
            scores = [scorer.score(t, values) for t in texts]
            known = [posterior[votes(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(known, pa.float64()), pa.array(scores, pa.float64()),
                                              pa.array([s >= threshold for s in scores], pa.bool_())],
                                             names=["doc_id", "posterior", "score", "kept"])

    return rows.select("doc_id", "text").mapInArrow(judge, "doc_id long, posterior double, score double, kept boolean")
