"""k-means of four kinds over (doc_id, vec), with first variation and splitting.

The driver holds k centers (k is a parameter) and a few numbers for each round. A round scans the points in
Arrow batches, keeps a sum and a count for each cluster and task, and adds these up by (cluster, position). Points that are
all zero take no part and get cluster -1.

Kinds: ``spherical`` (unit vectors, dot product), ``euclidean`` (squared distance), ``kl`` (distributions weighted
by their mass, divergence in bits), ``diametric`` (squared dot product; the center is the cluster's dominant direction).
All are written as gains to maximise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.shared import cut

KINDS = ("spherical", "euclidean", "kl", "diametric")
#: The high bits of a multiplicative hash of an id and a seed, in SQL.
RANDOM_LABELS = "((({0} % 2147483648 + 2147483648) % 2147483648 * 2654435761 + {1} * 40503) % 4294967296) // 65536"


def prepare(x: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised rows and their weights: unit length, as they are, or shares of their sum (weight: the sum)."""
    x = np.asarray(x, float)
    if kind in ("spherical", "diametric"):
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), np.ones(len(x))
    if kind == "kl":
        mass = np.abs(x).sum(axis=1, keepdims=True)
        return np.divide(np.abs(x), mass, out=np.zeros_like(x), where=mass > 0), mass[:, 0]
    return x, np.ones(len(x))


def gains(x: np.ndarray, centers: np.ndarray, kind: str, alpha: float = 0.0) -> np.ndarray:
    """Points by centers: what a point adds to the objective in a cluster; larger is better."""
    if kind == "spherical":
        return x @ centers.T
    if kind == "diametric":
        return (x @ centers.T) ** 2
    if kind == "euclidean":
        return -((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :])
    smooth = (centers + alpha / x.shape[1]) / (1 + alpha)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log2(smooth)
        own = np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0).sum(axis=1)
    finite = np.where(np.isfinite(logs), logs, 0)
    lacking = (x > 0).astype(float) @ (~np.isfinite(logs)).T.astype(float)
    return np.where(lacking > 0, -1e20, x @ finite.T - own[:, None])


def power_iteration(gram: np.ndarray, start: np.ndarray | None = None, epsilon: float = 1e-4, most: int = 1000) -> tuple[np.ndarray, float]:
    """Dominant eigenvector (unit length) and eigenvalue of a symmetric matrix."""
    v = np.ones(len(gram)) if start is None or not start.any() else start.astype(float)
    v, value = v / np.linalg.norm(v), 0.0
    for _ in range(most):
        w = gram @ v
        new = float(np.linalg.norm(w))
        if new == 0:
            return v, 0.0
        w /= new
        done = abs(new - value) <= epsilon * max(1.0, new) and np.linalg.norm(w - v) <= epsilon
        v, value = w, new
        if done:
            break
    return v, value


@dataclass
class State:
    """Centers with the clusters' sums (or second moments), weights and the objective."""

    kind: str
    centers: np.ndarray
    sums: np.ndarray
    weights: np.ndarray
    objective: float
    history: list[float] = field(default_factory=list)
    settled: bool = False


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vec"].to_numpy()).astype(float) if len(frame) else np.zeros((0, 0))


def assign(points: DataFrame, centers: np.ndarray, kind: str, alpha: float = 0.0, moves: dict[int, int] | None = None, digits: int | None = None) -> DataFrame:
    """Points with ``cluster``: that of the largest gain, of equal ones the lowest; with ``moves`` some documents are placed by hand.

    A point that has a cluster already keeps it unless another one's gain is strictly larger. With ``digits`` gains are compared as rounded.
    """
    moves, has = moves or {}, "cluster" in points.columns

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x, _ = prepare(_matrix(f), kind)
            g = gains(x, centers, kind, alpha)
            if digits is not None:
                g = np.sign(g) * np.floor(np.abs(g) * 10.0**digits + 0.5)
            best = g.argmax(axis=1)
            if has:
                own = f["cluster"].to_numpy().clip(0, len(centers) - 1)
                best = np.where(g[np.arange(len(x)), own] >= g.max(axis=1), own, best)
            best = np.array([moves.get(int(d), int(b)) for d, b in zip(f["doc_id"], best, strict=True)])
            yield pd.DataFrame({"doc_id": f["doc_id"], "vec": f["vec"], "cluster": np.where(x.any(axis=1), best, -1)})

    return points.mapInPandas(run, "doc_id long, vec array<double>, cluster int")


def update(assigned: DataFrame, k: int, kind: str, old: np.ndarray | None = None, omega: float = 0.0) -> State:
    """New centers, sums and objective of assigned points. An empty cluster keeps its old center."""

    def run(frames):
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            if not len(f):
                continue
            x, w = prepare(_matrix(f), kind)
            own = f["cluster"].to_numpy()
            squares = np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0).sum(axis=1) if kind == "kl" else (x * x).sum(axis=1)
            for c in np.unique(own[own >= 0]):
                at = own == c
                body = (x[at].T @ x[at]).reshape(-1) if kind == "diametric" else (x[at] * w[at, None]).sum(axis=0)
                part = np.concatenate([[w[at].sum(), (w[at] * squares[at]).sum()], body])
                sums[int(c)] = sums.get(int(c), 0) + part
        for c, part in sums.items():
            yield pd.DataFrame({"cluster": c, "pos": np.arange(len(part)), "x": part})

    rows = assigned.mapInPandas(run, "cluster int, pos int, x double").groupBy("cluster", "pos").agg(F.sum("x").alias("x")).toPandas()
    width = int(rows["pos"].max()) + 1 if len(rows) else 2
    table = np.zeros((k, width))
    table[rows["cluster"], rows["pos"]] = rows["x"]
    weights, squares, body = table[:, 0], table[:, 1], table[:, 2:]
    if kind == "diametric":
        d = int(round(body.shape[1] ** 0.5))
        sums, centers, total = body.reshape(k, d, d), np.zeros((k, d)), 0.0
        for c in range(k):
            centers[c], value = power_iteration(sums[c], old[c] if old is not None else None)
            total += value
    elif kind == "spherical":
        sums = body
        norms = np.sqrt((sums * sums).sum(axis=1))
        centers, total = np.divide(sums, norms[:, None], out=np.zeros_like(sums), where=norms[:, None] > 0), float(norms.sum())
    else:
        sums = body
        centers = np.divide(sums, weights[:, None], out=np.zeros_like(sums), where=weights[:, None] > 0)
        if kind == "euclidean":
            total = -float((squares - (sums * centers).sum(axis=1)).sum())
        else:
            total = -float((squares - weights * np.where(centers > 0, centers * np.log2(np.where(centers > 0, centers, 1)), 0).sum(axis=1)).sum())
    if old is not None:
        centers = np.where((weights > 0)[:, None], centers, old)
    return State(kind, centers, sums, weights, total - omega * k)


def farthest_documents(points: DataFrame, k: int, kind: str) -> tuple[list[int], np.ndarray]:
    """k seeds, their ids and vectors: the point least like the mean of all, then each time the point with the least sum of gains to those chosen; of equal ones the lowest id."""
    everything = update(points.withColumn("cluster", F.lit(0)), 1, kind)
    chosen: list[tuple[int, np.ndarray]] = []

    def least(against: np.ndarray, taken: set[int]):
        def run(frames):
            best = None
            for f in frames:
                if not len(f):
                    continue
                x, _ = prepare(_matrix(f), kind)
                score = np.round(gains(x, against, kind, 1e-9 if kind == "kl" else 0.0).sum(axis=1), 9)
                for i in np.lexsort((f["doc_id"], score)):
                    key = (float(score[i]), int(f["doc_id"].iloc[i]))
                    if key[1] not in taken and x[i].any():
                        if best is None or key < best[0]:
                            best = key, x[i]
                        break
            if best is not None:
                yield pd.DataFrame({"score": [best[0][0]], "doc_id": [best[0][1]], "vec": [best[1].tolist()]})

        return points.mapInPandas(run, "score double, doc_id long, vec array<double>").orderBy("score", "doc_id").first()

    for _ in range(k):
        row = least(np.stack([v for _, v in chosen]) if chosen else everything.centers, {d for d, _ in chosen})
        if row is None:
            break
        chosen.append((row["doc_id"], np.array(row["vec"])))
    return [d for d, _ in chosen], np.stack([v for _, v in chosen])


def random_labels(points: DataFrame, k: int, seed: int) -> DataFrame:
    """Clusters by a multiplicative hash of the id."""
    return points.withColumn("cluster", F.pmod(F.expr(RANDOM_LABELS.format("doc_id", seed).replace("//", "div")), F.lit(k)).cast("int"))


def start(points: DataFrame, k: int, kind: str, init: str | DataFrame = "separated", seed: int = 1) -> np.ndarray:
    """Centers to start from: ``separated`` (farthest first), ``random`` labels, ``perturbed`` (the mean with noise), or a table (doc_id, cluster)."""
    if isinstance(init, DataFrame):
        return update(points.join(init.select("doc_id", F.col("cluster").cast("int").alias("cluster")), "doc_id"), k, kind).centers
    if init == "separated":
        return farthest_documents(points, k, kind)[1]
    if init == "random":
        return update(random_labels(points, k, seed), k, kind).centers
    if init == "perturbed":
        mean = update(points.withColumn("cluster", F.lit(0)), 1, kind).centers
        noise = np.random.default_rng(seed).normal(0, 0.1, (k, mean.shape[1])) * np.abs(mean).max()
        moved = np.abs(mean + noise) if kind == "kl" else mean + noise
        return prepare(moved, kind)[0]
    raise ValueError(f"no initialiser named {init}")


def kmeans(points: DataFrame, k: int, kind: str = "spherical", init: str | DataFrame = "separated", epsilon: float = 1e-3, rounds: int = 50, omega: float = 0.0, seed: int = 1, alpha: float = 0.0) -> tuple[DataFrame, State]:
    """Points (doc_id, vec, cluster) and the last state.

    Rounds end when the objective gains no more than ``epsilon`` of its size (euclidean: of the first objective). With ``alpha``, kl centers are smoothed
    and alpha is halved every round until it falls to ``epsilon``. Without that end after ``rounds``, the state isn't ``settled``.
    """
    centers, history = start(points, k, kind, init, seed), []
    k = len(centers)
    smoothing = alpha if kind == "kl" else 0.0
    if kind == "kl" and not smoothing:
        smoothing = 1e-9
    while True:
        state = update(assign(points, centers, kind, smoothing), k, kind, centers, omega)
        history.append(state.objective)
        centers = state.centers
        scale = abs(history[0]) if kind == "euclidean" else abs(history[-1])
        settled = len(history) > 1 and history[-1] - history[-2] <= epsilon * scale and (alpha == 0 or smoothing <= epsilon)
        if settled or len(history) >= rounds:
            break
        if alpha and smoothing > epsilon:
            smoothing /= 2
    state.history, state.settled = history, settled
    return cut(assign(points, centers, kind, smoothing)), state


def move_gains(x: np.ndarray, w: np.ndarray, own: np.ndarray, state: State) -> np.ndarray:
    """Points by clusters: the gain in the objective if the point moved there; 0 to its own cluster or from a cluster of one."""
    k, kind = len(state.centers), state.kind
    out = np.zeros((len(x), k))
    if kind == "spherical":
        a = np.sqrt((state.sums**2).sum(axis=1))
        s = x @ state.centers.T
        leave = np.sqrt(np.maximum(0, a[own] ** 2 - 2 * a[own] * s[np.arange(len(x)), own] + 1)) - a[own]
        out = leave[:, None] + np.sqrt(a[None, :] ** 2 + 2 * a[None, :] * s + 1) - a[None, :]
    elif kind == "euclidean":
        d, n = -gains(x, state.centers, kind), state.weights
        leave = n[own] / np.maximum(n[own] - 1, 1) * d[np.arange(len(x)), own]
        out = leave[:, None] - n[None, :] / (n[None, :] + 1) * d
    else:
        def quality(c, sums, weight):
            if kind == "diametric":
                return power_iteration(sums, state.centers[c])[1]
            p = sums / weight if weight > 0 else sums
            return weight * np.where(p > 1e-300, p * np.log2(np.where(p > 1e-300, p, 1)), 0).sum()

        own_quality = [quality(c, state.sums[c], state.weights[c]) for c in range(k)]
        for i in range(len(x)):
            part = np.outer(x[i], x[i]) if kind == "diametric" else w[i] * x[i]
            leave = quality(own[i], np.maximum(state.sums[own[i]] - part, 0) if kind == "kl" else state.sums[own[i]] - part, state.weights[own[i]] - w[i]) - own_quality[own[i]]
            out[i] = [leave + quality(c, state.sums[c] + part, state.weights[c] + w[i]) - own_quality[c] for c in range(k)]
    out[np.arange(len(x)), own] = 0
    return out


def move_table(assigned: DataFrame, state: State, counts: np.ndarray) -> DataFrame:
    """(doc_id, cluster, target, gain) of every document and other cluster."""

    def run(frames):
        for f in frames:
            f = f[f["cluster"] >= 0]
            if not len(f):
                continue
            x, w = prepare(_matrix(f), state.kind)
            own = f["cluster"].to_numpy()
            g = move_gains(x, w, own, state)
            g[counts[own] <= 1] = 0
            i, c = np.nonzero(np.arange(g.shape[1])[None, :] != own[:, None])
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy()[i], "cluster": own[i], "target": c, "gain": g[i, c]})

    return assigned.mapInPandas(run, "doc_id long, cluster int, target int, gain double")


def _counts(assigned: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k, int)
    for c, n in assigned.where("cluster >= 0").groupBy("cluster").count().collect():
        out[c] = n
    return out


def first_variation(assigned: DataFrame, state: State, steps: int = 3) -> tuple[DataFrame, float]:
    """The best prefix of a chain of best single moves, each of another document, and its gain.

    A step is one job that finds the best move; the chain's moves are kept by the driver, ``steps`` at most.
    """
    k, moves, gain, best = len(state.centers), {}, 0.0, (0.0, {})
    now = state
    for _ in range(steps):
        placed = assign_fixed(assigned, moves)
        free = placed.where(~F.col("doc_id").isin(list(moves))) if moves else placed
        row = move_table(free, now, _counts(placed, k)).where("gain <> 0").orderBy(F.round("gain", 9).desc(), "doc_id", "target").first()
        if row is None:
            break
        moves = moves | {row["doc_id"]: row["target"]}
        gain += row["gain"]
        now = update(assign_fixed(assigned, moves), k, state.kind, now.centers)
        if gain > best[0] + 1e-12:
            best = gain, moves
    return assign_fixed(assigned, best[1]), best[0]


def assign_fixed(assigned: DataFrame, moves: dict[int, int]) -> DataFrame:
    """Assigned points with some documents' clusters replaced."""
    if not moves:
        return assigned
    table = F.create_map(*[F.lit(x).cast(t) for pair in moves.items() for x, t in zip(pair, ("long", "int"), strict=True)])
    return assigned.withColumn("cluster", F.coalesce(F.try_element_at(table, F.col("doc_id")), F.col("cluster")))


def worst(assigned: DataFrame, state: State) -> int | None:
    """The document with the least gain in its own cluster, the lowest id of equal ones."""

    def run(frames):
        for f in frames:
            f = f[f["cluster"] >= 0]
            if len(f):
                x, _ = prepare(_matrix(f), state.kind)
                yield pd.DataFrame({"doc_id": f["doc_id"], "g": gains(x, state.centers, state.kind)[np.arange(len(x)), f["cluster"].to_numpy()]})

    row = assigned.mapInPandas(run, "doc_id long, g double").orderBy(F.round("g", 9), "doc_id").first()
    return None if row is None else row["doc_id"]


def split_worst(assigned: DataFrame, state: State, omega: float = 0.0) -> tuple[DataFrame, State, float]:
    """The worst document as a cluster of its own, if the objective gains more than ``omega``; else no change and gain 0."""
    k, doc = len(state.centers), worst(assigned, state)
    if doc is None:
        return assigned, state, 0.0
    new = assign_fixed(assigned, {doc: k})
    now = update(new, k + 1, state.kind, np.vstack([state.centers, np.zeros((1, state.centers.shape[1]))]))
    before = update(assigned, k, state.kind, state.centers).objective
    gain = now.objective - before - omega
    return (new, now, gain) if gain > 0 else (assigned, state, 0.0)


def without_empty(assigned: DataFrame) -> DataFrame:
    """Clusters numbered without gaps, in their order."""
    used = assigned.where("cluster >= 0").select("cluster").distinct().withColumn("new", F.row_number().over(Window.orderBy("cluster")) - 1)  # over clusters
    return assigned.join(used, "cluster", "left").withColumn("cluster", F.coalesce("new", F.lit(-1)).cast("int")).select("doc_id", "vec", "cluster")


def ping_pong(points: DataFrame, k: int, kind: str = "spherical", rounds: int = 5, steps: int = 2, splits: int = 0, omega: float = 0.0, **options) -> tuple[DataFrame, float]:
    """k-means, then first variation and splitting until neither gains; the points and the objective."""
    assigned, state = kmeans(points, k, kind, **options)
    for _ in range(rounds):
        assigned, gain = first_variation(assigned, state, steps)
        assigned = cut(without_empty(assigned))
        k = assigned.agg(F.max("cluster")).first()[0] + 1
        state = update(assigned, k, kind)
        more = 0.0
        for _ in range(splits):
            assigned, state, more = split_worst(assigned, state, omega)
            if more:
                assigned = cut(assigned)
        if gain <= 1e-9 and more <= 1e-9:
            break
        assigned, state = kmeans(points, len(state.centers), kind, init=assigned.where("cluster >= 0").select("doc_id", "cluster"), **{x: y for x, y in options.items() if x != "init"})
    return assigned, state.objective


def sequential_moves(x: np.ndarray, w: np.ndarray, own: np.ndarray, k: int, sweeps: int) -> None:
    """Moves the clusters ``own`` of distributions ``x`` of weight ``w`` in place, row by row, until a sweep has no moves.

    A cluster's information is the sum of s log s over its sums s, minus that of its mass: it is kept by cluster, so a row takes the logarithms of its k joint sums only.
    """
    parts, d = x * w[:, None], x.shape[1]
    mass, sums = np.zeros(k), np.zeros((k, d))
    np.add.at(mass, own, w)
    np.add.at(sums, own, parts)
    # Rows 0 to k - 1 of ``both`` are sums with the row joined, row k is its own cluster without it.
    both, logs, heavy = np.empty((k + 1, d)), np.empty((k + 1, d)), np.empty(k + 1)

    def information(v, m):
        np.log2(np.maximum(v, 1e-300, out=logs[: len(v)]), out=logs[: len(v)])
        return np.einsum("ij,ij->i", v, logs[: len(v)]) - m * np.log2(np.maximum(m, 1e-300))

    alone = information(sums, mass)
    single = np.array([information(parts[i : i + 1], w[i : i + 1])[0] for i in range(len(x))])
    for _ in range(sweeps):
        moved = 0
        for i, c in enumerate(own.tolist()):
            mass[c] -= w[i]
            np.maximum(sums[c] - parts[i], 0, out=sums[c])
            np.add(sums, parts[i], out=both[:k])
            both[k], heavy[:k], heavy[k] = sums[c], mass + w[i], mass[c]
            found = information(both, heavy)
            alone[c] = found[k] if mass[c] > 1e-12 else 0.0
            cost = alone + single[i] - found[:k]
            new = int(cost.argmin())
            if not cost[new] < cost[c] - 1e-12:
                new = c
            mass[new] += w[i]
            sums[new], alone[new] = both[new], found[new]
            moved += new != c
            own[i] = new
        if not moved:
            break


def information_bottleneck(points: DataFrame, k: int, sweeps: int = 30, seed: int = 1, init: DataFrame | None = None) -> DataFrame:
    """(doc_id, cluster) by sequential moves: each document in turn goes where the loss of information is least.

    Moves depend on all moves before, so this is one task's work by nature; meant for tables that fit in one. Ends after
    ``sweeps`` or a sweep without moves.
    """
    rows = points.select("doc_id", "vec", F.lit(None).cast("int").alias("cluster")) if init is None else points.join(init.select("doc_id", "cluster"), "doc_id", "left")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id", ignore_index=True)
        x, w = prepare(_matrix(f), "kl")
        w = w / w.sum() if w.sum() else w
        rng = np.random.default_rng(seed)
        own = np.where(f["cluster"].notna(), f["cluster"].fillna(0), rng.integers(0, k, len(f))).astype(int)
        live = x.any(axis=1)
        sequential_moves(x[live], w[live], moving := own[live], k, sweeps)
        own[live] = moving
        return pd.DataFrame({"doc_id": f["doc_id"], "cluster": np.where(live, own, -1)})

    return rows.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(run, "doc_id long, cluster int")


def signed_split(assigned: DataFrame, state: State) -> DataFrame:
    """(doc_id, cluster): diametric clusters split into documents along (2c) and against (2c + 1) the center."""

    def run(frames):
        for f in frames:
            if len(f):
                x, _ = prepare(_matrix(f), "diametric")
                own = f["cluster"].to_numpy()
                side = (x * state.centers[own.clip(0)]).sum(axis=1) < 0
                yield pd.DataFrame({"doc_id": f["doc_id"], "cluster": np.where(own < 0, -1, 2 * own + side)})

    return assigned.mapInPandas(run, "doc_id long, cluster int")


def word_clusters(cells: DataFrame, assigned: DataFrame) -> DataFrame:
    """(word, cluster): for each word the cluster with the largest mean weight, the lowest of equal ones."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    sums = cells.join(assigned.select("doc_id", "cluster"), "doc_id").groupBy("cluster", "word").agg(F.sum("val").alias("s")).join(F.broadcast(sizes), "cluster")
    order = Window.partitionBy("word").orderBy(F.round(F.col("s") / F.col("size"), 9).desc(), "cluster")
    return sums.withColumn("k", F.row_number().over(order)).where("k = 1").select("word", "cluster")
