"""Hashed text features and cumulative-link (ordinal) linear models, shared by the classifiers.

Features of a text, hashed to ``DIMENSIONS``: presence of each word (lower case, without punctuation at its ends)
and of its first four and five characters; the square root of the share of each word shape (upper or lower case,
and the punctuation it ends with); the square root of the share of words equal to the word before.

Models are fitted on the driver on a sample of labelled rows: ``SAMPLE`` ids at most, the first by a hash, one row of each (of rows that repeat an id the
one with the least hash of its text), and ``ENTRIES`` hashed features of a row at most, those of the least hash. Only these features get there, so their
number is bounded whatever the table holds. Texts are scored by all their features.

Of the hashed word features a model uses ``CHOSEN``, the best by chi-square on its training rows. This is a parameter of every fit (``most``): with more
of them held-out loss grows, as labelled rows are few (README).
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import slices

DIMENSIONS, SAMPLE, CHOSEN, REMEMBER, ENTRIES = 1 << 20, 8000, 300, 200_000, 8192
_REPEATS = zlib.crc32(b"repeats") % DIMENSIONS


def _hash(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % DIMENSIONS


def shape(word: str) -> str:
    n = len(word)
    while n and not word[n - 1].isalnum():
        n -= 1
    return ("U" if n > 1 and word[:n].isupper() else "l" if n else "") + word[n : n + 3]


def word_features(word: str) -> tuple[int, ...]:
    w = word.lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    w = w[a:b]
    if not w:
        return ()
    return tuple({_hash("w", w), *(_hash(f"p{k}", w[:k]) for k in (4, 5) if len(w) >= k)})


class Extractor:
    """Features of texts; with ``only``, no others than these. Remembers words in a bounded table."""

    def __init__(self, only: set[int] | None = None):
        self.only = only
        self.known: dict[str, tuple[tuple[int, ...], int]] = {}

    def _learn(self, word: str) -> tuple[tuple[int, ...], int]:
        found, own = word_features(word), _hash("s", shape(word))
        if self.only is not None:
            found = tuple(i for i in found if i in self.only)
        if len(word) < 64:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[word] = found, own
        return found, own

    def features(self, text: str | None) -> tuple[set[int], dict[int, float]]:
        """Present words and prefixes, and shares by shape."""
        words = (text or "").split()
        present: set[int] = set()
        shapes: dict[int, int] = {}
        find = self.known.get
        for word, n in Counter(words).items():
            found, own = find(word) or self._learn(word)
            if found:
                present.update(found)
            shapes[own] = shapes.get(own, 0) + n
        if len(words) > 1:
            shapes[_REPEATS] = sum(map(eq, words, islice(words, 1, None)))
        return present, {k: (n / len(words)) ** 0.5 for k, n in shapes.items() if n}


class Sample:
    """Sparse rows: word features at first, then shares, with a label matrix."""

    def __init__(self, labels: np.ndarray, words: tuple[np.ndarray, np.ndarray], shares: tuple[np.ndarray, np.ndarray, np.ndarray], fold: np.ndarray):
        small = lambda x: np.asarray(x).astype("int32", copy=False)
        (word_row, word), (share_row, share, self.value) = words, shares
        self.labels, self.fold, self.word_row, self.word, self.share_row, self.share = labels, fold, *map(small, (word_row, word, share_row, share))

    def __len__(self) -> int:
        return len(self.labels)


def labelled(df: DataFrame, labels: DataFrame, columns: list[str], text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE, folds: int = 5) -> Sample:
    """Features of the first ``rows`` labelled documents by a hash of their id; of repeated labels the least counts, of rows that repeat an id one is taken.

    The one is that of the least text hash, found with partial results in each task, so that no id gathers its rows.
    """
    known = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [id_col, *columns])).groupBy(id_col).agg(*[F.min(c).alias(c) for c in columns])
    few = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    names = [f"__l{i}" for i in range(len(columns))]
    few = few.select(F.col(id_col).alias("__id"), *[F.col(c).cast("int").alias(n) for c, n in zip(columns, names, strict=True)])
    joined = df.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(few), F.col(id_col) == F.col("__id"))
    one = joined.groupBy("__id", *names).agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("__one"))
    joined = one.select("__id", *names, F.col("__one.t").alias("__text"))
    source = joined.select("__id", F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(folds)).cast("int").alias("__fold"), *names, "__text")

    def run(batches):
        own = Extractor()
        for batch in batches:
            for part in slices(batch, "__text"):
                got = [own.features(t) for t in part.column("__text").to_pylist()]
                got = [(sorted(present)[:ENTRIES], sorted(shares)[:ENTRIES], shares) for present, shares in got]
                arrays = [pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.int32())), pa.array([[x[2][k] for k in x[1]] for x in got], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*part.schema.names[:-1], "word", "share", "value"])

    schema = f"__id long, __fold int, {', '.join(f'{n} int' for n in names)}, word array<int>, share array<int>, value array<float>"
    got = source.withColumn("__id", F.col("__id").cast("long")).mapInArrow(run, schema).toArrow().sort_by("__id").combine_chunks()

    def flat(name):
        a = pa.concat_arrays(got.column(name).chunks) if got.num_rows else pa.array([], pa.list_(pa.int32()))
        sizes = a.value_lengths().to_numpy(zero_copy_only=False) if len(a) else np.zeros(0, "int64")
        return np.repeat(np.arange(len(a), dtype="int32"), sizes), a.flatten().to_numpy(zero_copy_only=False)

    table = np.stack([got.column(n).to_numpy() for n in names], axis=1) if got.num_rows else np.zeros((0, len(names)), "int32")
    share_row, share = flat("share")
    return Sample(table, flat("word"), (share_row, share, flat("value")[1]), got.column("__fold").to_numpy())


class Model:
    """P(grade <= k) = sigmoid(threshold k - score): one weight for each feature, shared by ordered thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float], extra: list[float]):
        self.weights, self.thresholds, self.extra = weights, thresholds, extra

    def score(self, present: set[int], shares: dict[int, float], extra: list[float] = ()) -> float:
        w = self.weights
        return sum(w.get(i, 0.0) for i in sorted(present)) + sum(w.get(i, 0.0) * v for i, v in sorted(shares.items())) + sum(a * b for a, b in zip(self.extra, extra, strict=True))

    def tails(self, score: float) -> list[float]:
        """P(grade > k) for every threshold k."""
        return [float(_sigmoid(score - t)) for t in self.thresholds]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _choose(sample: Sample, rows: np.ndarray, grade: np.ndarray, classes: int, most: int | None) -> np.ndarray:
    """Word features, the ``most`` best by chi-square against the grades or all, and shares, that at least three of the rows have."""
    kinds = np.where(rows, grade, -1).astype("int8")[sample.word_row]
    counts = np.stack([np.bincount(sample.word[kinds == k], minlength=DIMENSIONS) for k in range(classes)]).astype("float32")
    total = counts.sum(0)
    size = np.array([np.sum(rows & (grade == k)) for k in range(classes)], float)
    want = np.outer(size / max(1, size.sum()), total)
    chi = np.where(total >= 3, np.divide((counts - want) ** 2, want, out=np.zeros_like(want), where=want > 0).sum(0), 0)
    best = np.flatnonzero(chi > 0) if most is None or most >= DIMENSIONS else np.argpartition(-chi, most)[:most]
    n = np.bincount(sample.share[rows[sample.share_row]], minlength=DIMENSIONS)
    return np.unique(np.concatenate([best[chi[best] > 0], np.flatnonzero(n >= 3)]))


def fit(sample: Sample, grade: np.ndarray, classes: int, rows: np.ndarray | None = None, extra: np.ndarray | None = None, steps: int = 300, decay: float = 5e-5, most: int | None = CHOSEN) -> Model:
    """Maximum likelihood with an L2 penalty by Adam, over the sample's ``rows``.

    ``most`` bounds the word features (None: all that three rows have), the best by chi-square; shares are always used.

    Grades that don't occur keep thresholds from smoothed shares; without any row all grades are as likely.
    """
    n = len(sample)
    rows = np.ones(n, bool) if rows is None else rows
    extra = np.zeros((n, 0)) if extra is None else extra
    chosen = _choose(sample, rows, grade, classes, most) if rows.any() else np.zeros(0, int)
    place = np.full(DIMENSIONS, -1, "int32")
    place[chosen] = np.arange(len(chosen))
    known = place >= 0
    words, shares = known[sample.word] & rows[sample.word_row], known[sample.share] & rows[sample.share_row]
    row = np.concatenate([sample.word_row[words], sample.share_row[shares]]).astype(int)
    column = place[np.concatenate([sample.word[words], sample.share[shares]])]
    value = np.concatenate([np.ones(int(words.sum())), sample.value[shares]])
    y, count, m = grade.astype(int), max(1, int(rows.sum())), len(chosen)
    share = np.cumsum([np.sum(rows & (y == k)) + 0.5 for k in range(classes)]) / (rows.sum() + 0.5 * classes)
    cuts = np.log(share[:-1] / (1 - share[:-1]))
    p = np.concatenate([np.zeros(m + extra.shape[1]), cuts[:1], np.log(np.diff(cuts))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1 if rows.any() and len(np.unique(y[rows])) > 1 else 1):
        w, v = p[:m], p[m : m + extra.shape[1]]
        gaps = np.exp(np.minimum(p[m + extra.shape[1] + 1 :], 5))
        t = np.concatenate([[-np.inf], p[m + extra.shape[1]] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(row, weights=value * w[column], minlength=n) + extra @ v
        high, low = _sigmoid(t[y + 1] - s), _sigmoid(t[y] - s)
        high, low = np.where(y == classes - 1, 1.0, high), np.where(y == 0, 0.0, low)
        prob = np.maximum(high - low, 1e-9)
        up, down = high * (1 - high) / prob * rows / count, low * (1 - low) / prob * rows / count
        ds = up - down
        dt = np.array([np.sum(down[y == k + 1]) - np.sum(up[y == k]) for k in range(classes - 1)])
        g = np.concatenate([np.bincount(column, weights=value * ds[row], minlength=m) + decay * w, extra.T @ ds + decay * v, [dt.sum()], [dt[k + 1 :].sum() * gaps[k] for k in range(classes - 2)]])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p -= 0.2 * (1 - 0.9 * step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    k = m + extra.shape[1]
    t = p[k] + np.concatenate([[0], np.cumsum(np.exp(np.minimum(p[k + 1 :], 5)))])
    return Model({int(i): float(x) for i, x in zip(chosen, p[:m], strict=True) if x}, [float(x) for x in t], [float(x) for x in p[m:k]])


def scores(sample: Sample, model: Model, extra: np.ndarray | None = None) -> np.ndarray:
    """Scores of the sample's rows."""
    w = np.zeros(DIMENSIONS)
    w[list(model.weights)] = list(model.weights.values())
    words, shares = (w != 0)[sample.word], (w != 0)[sample.share]
    out = np.bincount(sample.word_row[words], weights=w[sample.word[words]], minlength=len(sample))
    out += np.bincount(sample.share_row[shares], weights=w[sample.share[shares]] * sample.value[shares], minlength=len(sample))
    return out if extra is None else out + extra @ np.array(model.extra)
