"""k-means of sparse matrices: documents as lists of word numbers and values, centers as a table (cluster, word_id, s).

Neither a document nor a center is ever a dense row. Words are cut into parts of ``width`` numbers, so that the block of all centers over a part has ``ENTRIES``
numbers at most; a block is the only thing that the driver holds and broadcasts, one at a time. A matrix of one part (``words`` x k up to ``ENTRIES``) is assigned
where it lies, and a round without bounds is one pass over it that writes nothing but sums. With more parts each leaves partial gains, which are added up by document. Sums by
(cluster, word) leave each task once and are combined by Spark, which also adds up their squares; the matrix lies by document, so labels join it where it is.

Kinds are those of ``clustering``: ``spherical`` scales documents to unit length, ``kl`` to shares of their mass, which weighs them, ``euclidean`` leaves them as
they are. Gains are rounded to nine digits, so that the order of summation decides nothing; of equal ones the lowest cluster wins.

Similarity bounds (spherical, one part): a unit vector's product with a center changes by no more than the center moves. Each document carries, for every other center,
its last product plus the movements since. Where that is below the product with its own center, the new product isn't computed; what is compared is the same.
The bounds lie beside the document and are rewritten with it, without a shuffle.

Defined results: null cells and zeros are no entries, cells of one document and word are added up; a document without entries takes no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.clustering import RANDOM_LABELS
from brindle.sources.shared import bucketed, scratch

KINDS = ("spherical", "euclidean", "kl")
#: Numbers of a block of centers (128 MB), smoothing of kl centers, and what bounds may lack by rounding.
ENTRIES, ALPHA, SLACK = 1 << 24, 1e-9, 1e-8
_ROW = "doc_id long, w double, own double, idx array<int>, val array<double>, cluster int, sims array<double>, products int"
#: Sums by cluster and word; below 0 the documents' weights, own terms, number and products.
_SUM, _WEIGHT, _OWN, _COUNT, _PRODUCTS = "cluster int, word_id long, s double", -1, -2, -3, -4


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    folder, writer = scratch(df.sparkSession, name), df.write
    (writer.partitionBy(by) if by else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@dataclass
class Matrix:
    """Rows (doc_id, w, own, idx, val, part) of prepared documents; idx counts within the part. ``own`` is a document's own term in the objective, ``w`` its weight."""

    rows: DataFrame
    kind: str
    k: int
    words: int
    width: int

    @property
    def parts(self) -> int:
        return max(1, -(-self.words // self.width))


@dataclass
class State:
    """Sums (cluster, word_id, s), and by cluster the weights and the square lengths of the sums; the objective, and the share of products that the assignment computed, of this and of all rounds."""

    sums: DataFrame
    weights: np.ndarray
    squares: np.ndarray
    objective: float = float("nan")
    share: float = 1.0
    history: list[float] = field(default_factory=list)
    computed: list[float] = field(default_factory=list)
    settled: bool = False


def prepared(cells: DataFrame, kind: str) -> DataFrame:
    """(doc_id, word_id, x, w, own): entries scaled for ``kind``."""
    doc = Window.partitionBy("doc_id")
    own = cells.where("doc_id IS NOT NULL AND word_id IS NOT NULL AND val IS NOT NULL").groupBy("doc_id", "word_id").agg(F.sum(F.col("val").cast("double")).alias("x")).where("x <> 0")
    if kind == "spherical":
        return own.withColumns({"x": F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(doc)), "w": F.lit(1.0), "own": F.lit(0.0)})
    if kind == "kl":
        shares = own.withColumn("w", F.sum(F.abs("x")).over(doc)).withColumn("x", F.abs("x") / F.col("w"))
        return shares.withColumn("own", F.sum(F.col("x") * F.log2("x")).over(doc))
    return own.withColumns({"w": F.lit(1.0), "own": F.sum(F.col("x") * F.col("x")).over(doc)})


def matrix(cells: DataFrame, words: int, k: int, kind: str = "spherical", entries: int = ENTRIES, parts: int = 0) -> Matrix:
    """From cells (doc_id, word_id, val), word_id from 0 to below ``words``. Written once, in ``parts`` buckets at least, and shuffled once, by document; a document's entries in a part are one row, of ``width`` entries at most."""
    width = max(1, entries // k)
    buckets = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    entry = F.struct((F.col("word_id") % width).cast("int").alias("i"), F.col("x").alias("x"))
    rows = prepared(cells.repartition(buckets, "doc_id"), kind).groupBy("doc_id", F.expr(f"CAST(word_id div {width} AS INT)").alias("part")).agg(F.first("w").alias("w"), F.first("own").alias("own"), F.sort_array(F.collect_list(entry)).alias("e"))
    rows = rows.select("doc_id", "w", "own", F.col("e.i").alias("idx"), F.col("e.x").alias("val"), "part")
    return Matrix(bucketed(rows, "matrix", buckets, "doc_id"), kind, k, words, width)


def _flat(batch: pa.RecordBatch):
    """Row numbers, word numbers and values of a batch's entries."""
    idx, val = batch.column("idx"), batch.column("val")
    sizes = idx.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)


def _products(batch: pa.RecordBatch, block: np.ndarray) -> np.ndarray:
    """Sparse by dense: rows x clusters."""
    row, idx, val = _flat(batch)
    return np.stack([np.bincount(row, weights=val * center[idx], minlength=batch.num_rows) for center in block], axis=1)


def _dense(m: Matrix, sums: DataFrame, part: int) -> np.ndarray:
    """The sums of a part, ENTRIES at most."""
    here = sums.where(F.expr(f"word_id div {m.width}") == part).select("cluster", (F.col("word_id") % m.width).cast("int").alias("i"), "s").toArrow()
    out = np.zeros((m.k, max(0, min(m.width, m.words - part * m.width))))
    out[here.column("cluster").to_numpy(), here.column("i").to_numpy()] = here.column("s").to_numpy()
    return out


def block(m: Matrix, state: State, part: int) -> np.ndarray:
    """k x width factors of the words of a part: a document's gain in a cluster is its product with them, plus the cluster's constant."""
    sums = _dense(m, state.sums, part)
    weights = np.where(state.weights > 0, state.weights, 1)[:, None]
    if m.kind == "spherical":
        return sums / np.sqrt(np.where(state.squares > 0, state.squares, 1))[:, None]
    if m.kind == "euclidean":
        return 2 * sums / weights
    return np.log2((sums / weights + ALPHA / m.words) / (1 + ALPHA))


def constants(m: Matrix, state: State) -> np.ndarray:
    return -state.squares / np.where(state.weights > 0, state.weights, 1) ** 2 if m.kind == "euclidean" else np.zeros(m.k)


def assign(m: Matrix, now: DataFrame, state: State, moved: np.ndarray | None = None, centers: np.ndarray | None = None, fold: bool = False) -> DataFrame:
    """``now`` with new clusters: of one part the matrix' rows (``_ROW``) or, with ``fold``, their sums (``_SUM``), of more the documents (doc_id, cluster).

    With ``moved``, how far each center went since the last round, products that can't win aren't computed; ``products`` counts the others.
    """
    const = constants(m, state)
    if m.parts > 1:
        return _assign_parts(m, state, const)
    center = now.sparkSession.sparkContext.broadcast(block(m, state, 0) if centers is None else centers)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                yield step(batch.slice(a, 4096))

    def step(batch):
        b, n = center.value, batch.num_rows
        every = np.arange(n)
        if moved is None:
            gains, count = _products(batch, b) + const, np.full(n, len(b))
        else:
            row, idx, val = _flat(batch)
            old = batch.column("cluster").to_numpy()
            bounds = batch.column("sims").flatten().to_numpy().reshape(n, -1) + moved
            dots = lambda rows, clusters: np.bincount(row[rows[row]], weights=(val * b[clusters[row], idx])[rows[row]], minlength=n)
            bounds[every, old] = dots(np.ones(n, bool), old)
            own, count, gains = bounds[every, old].copy(), np.ones(n, int), bounds
            sure = np.zeros(gains.shape, bool)
            sure[every, old] = True
            for c in range(len(b)):
                near = (old != c) & (bounds[:, c] >= own - SLACK)
                if near.any():
                    kept = near[row]
                    gains[near, c] = np.bincount(row[kept], weights=val[kept] * b[c, idx[kept]], minlength=n)[near]
                    sure[near, c] = True
                    count += near
        rounded = np.round(gains, 9)
        best = (rounded if moved is None else np.where(sure, rounded, -np.inf)).argmax(axis=1)
        sims = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(b) + 1, len(b)), pa.int32()), pa.array(gains.reshape(-1)))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "w", "own", "idx", "val")], pa.array(best, pa.int32()), sims, pa.array(count, pa.int32())], names=[x.split()[0] for x in _ROW.split(", ")])

    known = now.select(*[c for c in now.columns if c not in ("part", "products")])
    k, words = m.k, m.words
    return known.mapInArrow(lambda batches: _folded(k, words, run(batches)), _SUM) if fold else known.mapInArrow(run, _ROW)


def _folded(k: int, words: int, batches):
    """The sums (``_SUM``) of a task's rows of a matrix of one part."""
    sums, stats, seen = np.zeros(k * words), np.zeros((4, k)), False
    for batch in batches:
        row, idx, val = _flat(batch)
        cluster, w = batch.column("cluster").to_numpy(), batch.column("w").to_numpy()
        np.add.at(sums, cluster[row].astype("int64") * words + idx, val * w[row])
        products = batch.column("products").to_numpy() if "products" in batch.schema.names else np.full(len(w), k)
        for at, x in enumerate((w, w * batch.column("own").to_numpy(), np.ones(len(w)), products)):
            stats[at] += np.bincount(cluster, x, k)
        seen = True
    if not seen:
        return
    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k), 4), pa.int32()), pa.array(np.repeat([_WEIGHT, _OWN, _COUNT, _PRODUCTS], k)), pa.array(stats.reshape(-1))], names=["cluster", "word_id", "s"])
    for c in range(k):
        own = sums[c * words : (c + 1) * words]
        found = np.flatnonzero(own)
        for a in range(0, len(found), 1 << 16):
            at = found[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(at), pa.array(own[at])], names=["cluster", "word_id", "s"])


def _assign_parts(m: Matrix, state: State, const: np.ndarray) -> DataFrame:
    partial = []
    for part in range(m.parts):
        center = m.rows.sparkSession.sparkContext.broadcast(block(m, state, part))

        def run(batches, center=center):
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    own = batch.slice(a, 4096)
                    g = _products(own, center.value)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), *[pa.array(g[:, j]) for j in range(g.shape[1])]], names=["doc_id", *[f"g{j}" for j in range(g.shape[1])]])

        schema = "doc_id long, " + ", ".join(f"g{j} double" for j in range(m.k))
        partial.append(written(m.rows.where(F.col("part") == part).select("doc_id", "idx", "val").mapInArrow(run, schema), "gains"))
        center.destroy()  # the part's gains are written: one block at a time
    together = partial[0]
    for more in partial[1:]:
        together = together.unionByName(more)
    total = together.groupBy("doc_id").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(m.k)])
    gains = F.array(*[F.round(F.col(f"g{j}") + float(const[j]), 9) for j in range(m.k)])
    return total.select("doc_id", (F.array_position(gains, F.array_max(gains)) - 1).cast("int").alias("cluster"))


def _labelled(m: Matrix, now: DataFrame) -> DataFrame:
    return now if "idx" in now.columns else m.rows.join(now.select("doc_id", "cluster"), "doc_id")


def _stats(sums: DataFrame, k: int) -> tuple[np.ndarray, float, float, float]:
    """Weights by cluster, and the documents' own terms, number and products."""
    stats = np.zeros((4, k))
    for c, kind, x in sums.where("word_id < 0").select("cluster", "word_id", "s").collect():
        stats[-1 - kind, c] = x
    return stats[0], *stats[1:].sum(axis=1).tolist()


def _sums_of_parts(m: Matrix, rows: DataFrame) -> DataFrame:
    """As ``_folded``, of several parts."""
    k, width = m.k, m.width

    def run(batches):
        for batch in batches:
            row, idx, val = _flat(batch)
            cluster, w = batch.column("cluster").to_numpy(), batch.column("w").to_numpy()
            word = idx.astype("int64") + batch.column("part").to_numpy().astype("int64")[row] * width
            code, place = np.unique(word * k + cluster[row], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(code % k, pa.int32()), pa.array(code // k), pa.array(np.bincount(place, weights=val * w[row], minlength=len(code)))], names=["cluster", "word_id", "s"])

    docs = rows.groupBy("doc_id").agg(F.first("cluster").alias("cluster"), F.first("w").alias("w"), F.first("own").alias("own")).groupBy("cluster")
    sizes = docs.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("own")).alias("o"), F.count("*").cast("double").alias("n"))
    each = F.array(*[F.struct(F.lit(kind).cast("long").alias("word_id"), x.alias("s")) for kind, x in ((_WEIGHT, F.col("w")), (_OWN, F.col("o")), (_COUNT, F.col("n")), (_PRODUCTS, F.col("n") * k))])
    stats = sizes.select("cluster", F.explode(each).alias("e")).select("cluster", "e.word_id", "e.s")
    return rows.select("w", "idx", "val", "cluster", "part").mapInArrow(run, _SUM).unionByName(stats)


def update(m: Matrix, now: DataFrame, old: State | None = None) -> State:
    """Sums, weights and objective of assigned documents (or of their sums, ``_SUM``); a cluster without documents keeps its center."""
    k, words = m.k, m.words
    if "word_id" in now.columns:
        folded = now
    elif m.parts == 1:
        folded = _labelled(m, now).mapInArrow(lambda batches: _folded(k, words, batches), _SUM)
    else:
        folded = _sums_of_parts(m, _labelled(m, now))
    total = written(folded.groupBy("cluster", "word_id").agg(F.sum("s").alias("s")), "sums")
    weights, own, n, products = _stats(total, k)
    sums = total.where("word_id >= 0")
    if old is not None and (empty := [c for c in range(m.k) if not weights[c] and old.weights[c]]):
        # Written, as the next round may keep them again.
        sums = written(sums.unionByName(old.sums.where(F.col("cluster").isin(empty))), "sums")
    squares, entropy = np.zeros(m.k), np.zeros(m.k)
    p = F.col("s") / F.element_at(F.array(*[F.lit(float(w) if w > 0 else 1.0) for w in weights]), F.col("cluster") + 1)
    for c, q, e in sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")), F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))).collect():
        squares[c], entropy[c] = q, e
    real = weights > 0
    if m.kind == "spherical":
        objective = float(np.sqrt(squares[real]).sum())
    elif m.kind == "euclidean":
        objective = float((squares[real] / weights[real]).sum() - own)
    else:
        objective = float((weights * entropy)[real].sum() - own)
    if old is not None:
        weights = np.where(real, weights, old.weights)
    return State(sums, weights, squares, objective, share=products / max(1, n * m.k))


def random_labels(m: Matrix, seed: int) -> DataFrame:
    """(doc_id, cluster) by a multiplicative hash of the id."""
    cluster = F.pmod(F.expr(RANDOM_LABELS.format("doc_id", seed).replace("//", "div")), F.lit(m.k)).cast("int")
    return m.rows.select("doc_id", cluster.alias("cluster")).distinct()


def given(m: Matrix, centers: DataFrame) -> State:
    """A state from a table of centers (cluster, word_id, s), each of weight 1."""
    sums = written(centers.select(F.col("cluster").cast("int").alias("cluster"), F.col("word_id").cast("long").alias("word_id"), F.col("s").cast("double").alias("s")).where("s <> 0"), "sums")
    squares = sum(((_dense(m, sums, part)) ** 2).sum(axis=1) for part in range(m.parts))
    return State(sums, np.ones(m.k), squares)


def _entries(m: Matrix, doc_id: int, cluster: int) -> DataFrame:
    """A document as a center."""
    own = m.rows.where(F.col("doc_id") == doc_id)
    pairs = own.select("part", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    return pairs.select(F.lit(cluster).alias("cluster"), (F.col("part").cast("long") * m.width + F.col("e.idx")).alias("word_id"), F.col("e.val").alias("s"))


def separated(m: Matrix) -> tuple[list[int], State]:
    """k seeds: the document least like the mean, then each time that of the least sum of gains to those chosen; of equal ones the lowest id."""
    chosen: list[int] = []
    one = replace(m, k=1)
    state = update(one, m.rows.select("doc_id").distinct().withColumn("cluster", F.lit(0)) if m.parts > 1 else m.rows.withColumn("cluster", F.lit(0)))
    centers = None
    scores = None
    for _ in range(m.k):
        new = _gain(one, state)
        # The mean only chooses the first seed.
        scores = new if len(chosen) <= 1 else scores.join(new.withColumnRenamed("g", "more"), "doc_id").select("doc_id", (F.col("g") + F.col("more")).alias("g"))
        scores = written(scores, "scores")
        taken = F.col("doc_id").isin(chosen) if chosen else F.lit(False)
        row = scores.where(~taken).orderBy(F.round("g", 9), "doc_id").first()
        if row is None:
            break
        chosen.append(row["doc_id"])
        seed = written(_entries(m, chosen[-1], len(chosen) - 1), "seed")
        centers = seed if centers is None else centers.unionByName(seed)
        state = given(one, seed.withColumn("cluster", F.lit(0)))
    return chosen, given(m, centers)


def _gain(one: Matrix, state: State) -> DataFrame:
    """(doc_id, g): the gain of every document in the one cluster."""
    const, partial = float(constants(one, state)[0]), []
    for part in range(one.parts):
        center = block(one, state, part)

        def run(batches, center=center):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("own"), pa.array(_products(batch, center)[:, 0])], names=["doc_id", "own", "g"])

        partial.append(one.rows.where(F.col("part") == part).select("doc_id", "own", "idx", "val").mapInArrow(run, "doc_id long, own double, g double"))
    together = partial[0]
    for more in partial[1:]:
        together = together.unionByName(more)
    minus = F.lit(0.0) if one.kind == "spherical" else F.first("own")
    return together.groupBy("doc_id").agg((F.sum("g") + const - minus).alias("g"))


def kmeans(m: Matrix, init: DataFrame | State | str = "separated", epsilon: float = 1e-3, rounds: int = 1000, seed: int = 1, bounds: bool = True) -> tuple[DataFrame, State]:
    """(doc_id, cluster) and the last state; rounds end as in ``clustering.kmeans``. ``init``: labels (doc_id, cluster), a state, ``random`` or ``separated``.

    ``bounds`` (spherical, one part) skips products that can't win from the second round on; the rows are the same.
    """
    if isinstance(init, str):
        init = separated(m)[1] if init == "separated" else random_labels(m, seed)
    state = init if isinstance(init, State) else update(m, m.rows.join(init.select("doc_id", F.col("cluster").cast("int").alias("cluster")), "doc_id"))
    lone = m.parts == 1
    rows = m.rows.withColumns({"cluster": F.lit(0), "sims": F.lit(None).cast("array<double>")}) if lone else None
    now = rows
    history, computed, moved = [], [], None
    bounds = bounds and lone and m.kind == "spherical"
    centers = block(m, state, 0) if lone else None
    while True:
        now = assign(m, now, state, moved, centers, fold=lone and not bounds)
        now = written(now, "assigned") if bounds or not lone else now
        new = update(m, now, state)
        now = now if bounds or not lone else rows
        history.append(new.objective)
        computed.append(new.share)
        if lone:
            old, centers = centers, block(m, new, 0)
            moved = np.sqrt(((centers - old) ** 2).sum(axis=1)) if bounds else None
        state = new
        scale = abs(history[0]) if m.kind == "euclidean" else abs(history[-1])
        settled = len(history) > 1 and history[-1] - history[-2] <= epsilon * scale
        if settled or len(history) >= rounds:
            break
    state.history, state.computed, state.settled = history, computed, settled
    return written(assign(m, now, state, moved, centers).select("doc_id", "cluster"), "labels"), state


def word_clusters(m: Matrix, state: State) -> DataFrame:
    """(word_id, cluster): for each word that a center has, the cluster with the largest entry of its center, the lowest of equal ones."""
    scale = np.sqrt(state.squares) if m.kind == "spherical" else state.weights
    x = F.round(F.abs(F.col("s")) / F.create_map(*[F.lit(v) for c in range(m.k) for v in (c, float(scale[c]) or 1.0)])[F.col("cluster")], 9)
    best = state.sums.groupBy("word_id").agg(F.max(F.struct(x.alias("x"), (-F.col("cluster")).alias("c"))).alias("best"))
    return best.select("word_id", (-F.col("best.c")).cast("int").alias("cluster"))
