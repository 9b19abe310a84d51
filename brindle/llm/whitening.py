"""Embedding whitening by matrix-free block subspace iteration.

The covariance V of the vectors is never formed from the table's side: a pass over it gives XᵀXQ / n for a block Q of orthonormal
directions, X being the centred rows. The driver, which holds blocks of (dimensions x ``width``) numbers and no rows, then takes the
Ritz pairs of QᵀVQ (Rayleigh-Ritz); the same pass gives their residuals Vq - eq. The next block is the QR factor of VQ. Passes go on until the residuals
of the first k pairs are within ``certify`` of the largest eigenvalue, a few units of the precision of double numbers.

A pass costs a scan of the table, whatever the width, so blocks are wide: ``WIDTH`` directions, or all dimensions if there are fewer, when one pass certifies.
Narrower blocks converge with the ratio of the eigenvalues number width + 1 and k.

Entries become integers floor(1024 c) + 100000. Their sums are exact, and rows are centred in integers, as n x - S, before anything is multiplied; the
integers are kept in a table of their own, which every pass reads.

Defined results: vectors that are null, empty, hold a null or a non-finite entry, or an entry too large (over 2^31 as an integer), are left out; so are vectors of another length than the commonest
(of equally common ones the shortest). Rows without an id take part, repeated rows count as often as they occur, ties between eigenvalues leave
the choice of directions open, and a direction without variance (eigenvalue under 1e-9 of the largest) isn't a component; so equal vectors, or a single one, give no rows. ``deviation`` is
null where it is over 2^63 - 1. An empty table gives an empty result. Only the id and the vector are read; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import scratch

COMPONENTS, WIDTH, CERTIFY, MOST = 8, 128, 2e-14, 5000
SCALE, SHIFT, LEAST = 1024, 100_000, 1e-9
#: Rows that are centred at a time.
_ROWS = 2048


@dataclass
class Fit:
    """n vectors with sums S by dimension; eigenvalues and unit directions (columns), the trace of V, relative residuals and the number of passes."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def integers(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id_col, __x), written once: the valid vectors as integers."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("__x", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        for batch in batches:
            vec = batch.column("__v")
            flat = pc.list_flatten(vec)
            c = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(SCALE * c) + SHIFT
                bad = ~(np.abs(x) < 2**31)
            sizes = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            fine = (sizes > 0) & (np.bincount(row[bad], minlength=len(sizes)) == 0)
            kept = fine[row]
            offsets = np.concatenate([[0], np.cumsum(sizes[fine])]).astype("int32")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[kept].astype("int32")))], names=schema.names)

    folder = scratch(df.sparkSession, "vectors")
    df.select(id_col, F.col(vec_col).alias("__v")).mapInArrow(run, schema).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _rows(batch: pa.RecordBatch, d: int, rows: int = _ROWS):
    """Matrices of integers (int64) of a batch, some rows at a time, with the first row's number."""
    x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for a in range(0, len(x), rows):
        yield a, x[a : a + rows].astype("int64")


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from exact integers where they fit."""
    if n < 2**31:  # n x fits, as x does in 32 bits
        return (n * x - sums) / n
    whole = sums // n  # |S| is at most n 2^31: exact quotient, and the remainder under n
    return (x - whole) - (sums - whole * n) / n


def count_and_sums(ints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors of the commonest length and their sums; one row for each length and dimension leaves a task."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            flat, sizes = batch.column("__x").flatten().to_numpy(zero_copy_only=False), pc.list_value_length(batch.column("__x")).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                own = flat[np.repeat(sizes == d, sizes)].reshape(-1, d)
                n, s = found.get(int(d), (0, 0))
                found[int(d)] = n + len(own), s + own.sum(axis=0, dtype="int64")
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s, pa.int64())], names=["d", "i", "n", "s"])

    sums = ints.select("__x").mapInArrow(run, "d int, i int, n long, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = sums.where("i = 0").orderBy(F.desc("n"), "d").first()
    if best is None:
        return 0, np.zeros(0, "int64")
    return best["n"], np.array([r["s"] for r in sums.where(F.col("d") == best["d"]).orderBy("i").collect()], "int64")


def _pass(ints: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """V times a block, and the trace of V; dimensions x width sums leave a task."""
    d, w = block.shape

    def run(batches):
        total, trace = np.zeros((d, w)), 0.0
        for batch in batches:
            for _, x in _rows(batch, d):
                c = centred(x, n, sums)
                total += c.T @ (c @ block)
                trace += float((c * c).sum())
        flat = np.append(total.reshape(-1), trace)
        for a in range(0, len(flat), 65_536):
            part = flat[a : a + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part)), pa.int32()), pa.array(part)], names=["i", "s"])

    got = ints.select("__x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    flat = np.zeros(d * w + 1)
    flat[got.column("i").to_numpy()] = got.column("s").to_numpy()
    return flat[:-1].reshape(d, w) / n, flat[-1] / n


def fit(ints: DataFrame, k: int = COMPONENTS, width: int = WIDTH, certify: float = CERTIFY, most: int = MOST, seed: int = 1) -> Fit:
    """The first ``k`` components of the integer vectors of the commonest length.

    Raises if ``most`` passes don't certify them; nothing is returned that isn't certified.
    """
    n, sums = count_and_sums(ints)
    d = len(sums)
    if not n:
        return Fit(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0, np.zeros(0), 0)
    own = ints.where(F.size("__x") == d)
    k, width = min(k, d), min(max(width, k), d)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    for passes in range(1, most + 1):
        image, trace = _pass(own, n, sums, block)
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = block @ turn, image @ turn
        largest = max(values[0], 0.0)
        residuals = np.linalg.norm(moved - ritz * values, axis=0)[:k] / (largest or 1.0)
        # Rounding adds up along a row of d products.
        if residuals.max() <= certify * np.sqrt(d):
            real = values[:k] > LEAST * largest
            return Fit(n, sums, values[:k][real], ritz[:, :k][:, real], trace, residuals, passes)
        block = np.linalg.qr(moved)[0]
    raise RuntimeError(f"{most} passes left a residual of {residuals.max():.2g}")


def identity_error(ints: DataFrame, found: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, by a pass of its own."""
    if not len(found.values):
        return 0.0
    image, _ = _pass(ints.where(F.size("__x") == len(found.sums)), found.n, found.sums, found.directions)
    scale = np.sqrt(found.values)
    return float(np.abs(found.directions.T @ image / np.outer(scale, scale) - np.eye(len(scale))).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray, rough: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; ``rough`` are the same in double."""
    if n < 2**31 and rough.max(initial=0) < 2**62:
        y = n * x - sums
        return (y * y).sum(axis=1).tolist()
    found = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) if r < 2**64 else None for row, r in zip(x, rough, strict=True)]
    return [v if v is not None and v < 2**63 else None for v in found]


def whiten(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", k: int = COMPONENTS, **options) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for every valid vector and component."""
    ints = integers(df, vec_col, id_col)
    found = fit(ints, k, **options)
    error, n, sums = identity_error(ints, found), found.n, found.sums
    axes, shares = found.directions / np.sqrt(found.values), found.values / found.trace if found.trace else found.values
    many = len(found.values)
    schema = T.StructType([df.schema[id_col], T.StructField("component", T.IntegerType(), False), T.StructField("n", T.LongType(), False), T.StructField("deviation", T.LongType())])
    for c in ("whitened", "explained", "identity_error"):
        schema.add(c, T.DoubleType(), False)

    def run(batches):
        for batch in batches:
            for a, x in _rows(batch, len(sums)):
                c = centred(x, n, sums)
                m = len(x)
                deviations = _deviations(x, n, sums, (c * c).sum(axis=1) * float(n) ** 2)
                ids = batch.column(0).slice(a, m).take(pa.array(np.repeat(np.arange(m), many)))
                arrays = [
                    ids, pa.array(np.tile(np.arange(1, many + 1), m), pa.int32()), pa.array(np.full(m * many, n), pa.int64()), pa.array([v for v in deviations for _ in range(many)], pa.int64()),
                    pa.array((c @ axes).reshape(-1)), pa.array(np.tile(shares, m)), pa.array(np.full(m * many, error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    if not many:
        return df.sparkSession.createDataFrame([], schema)
    return ints.where(F.size("__x") == len(sums)).mapInArrow(run, schema)
