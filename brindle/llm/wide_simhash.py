"""SimHash near-duplicates down to a set similarity: wide fingerprints for texts further apart than a few bits.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in about 10 of a SimHash's 64 bits, one in ten thousand such
pairs in more than 20: no split of 64 bits leaves such pairs a block that still tells texts apart. So the fingerprint is wide, ``BLOCKS``
blocks of 64 bits, and each block is the SimHash (bit by bit the majority) of ``DRAWN`` shingles, each the least of the set under an order of its own.
Then the steps are those of the plain fingerprint: texts that share a block meet (a block is equal if its five shingles are),
a far Hamming distance of the whole fingerprints rules pairs out, and what is left is decided by the sets of shingles themselves.

Two sets of similarity 0.8 draw the same shingle with a chance of 0.8 and share a block with 0.33, none of 24 with 1 in 13,000; at 0.9 with
less than 1 in 10^9. Their distance is 237 of 1536 bits with a deviation of 40 (simulated), so ``FAR`` is five deviations off. A
pair missed is still found if a path of others joins the two.

Blocks join their texts to the least of the bucket; the components of these links hold every pair worth a look. First every text is compared with one other, the
least of all its buckets: what is alike forms classes, so a large group of near copies costs one comparison a copy. Then, in
components of several classes, texts of different classes are compared unless a path joins them already. Stars and components of many or long texts
are dealt into parts, each star's part and every pair of parts a task's work of its own; two parts of one class are no work. Texts with equal sets
are one entry.

Defined results: a text of fewer words than a shingle has one shingle, all its words; texts without words (null, empty,
white space) are alike. Rows without an id take part; of a group without any id, one row stays. Of repeated rows one stays. An empty
table gives an empty one. Very long texts are hashed whole, a megabyte at a time. Extra columns pass through, whatever their names but ``__i``, ``__n``, ``__k``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import cut, one_of_each, release, slices
from brindle.llm.components import components
from brindle.llm.simhash import SEED, Forest, _word_runs
from brindle.operators.joins import spread_join

BLOCKS, DRAWN, FAR = 24, 5, 440
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BLOCKS * DRAWN, "uint64") * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, BLOCKS * DRAWN, "uint64")
_MIX = _RNG.integers(0, 1 << 63, 2, "uint64") * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, in order."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found, carry = [], []
    for words in _word_runs((text or "").encode().lower()):
        words = carry + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - width].tolist()]
            found.append(np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "uint64")))
        carry = words[max(0, len(words) - width + 1) :]
    if not found:
        return np.array([digest(b" ".join(carry), SEED)] if carry else [], "uint64")
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def majority(a, b, c, d, e):
    """Bit by bit the value that three of five words or more have."""
    first, second = a ^ b ^ c, (a & b) | (c & (a ^ b))
    last, third = first ^ d ^ e, (first & d) | (e & (first ^ d))
    return (second & third) | ((second ^ third) & last)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The blocks of a set of shingle hashes; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, "uint64")
    least = np.full(BLOCKS * DRAWN, np.iinfo("uint64").max)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i : i + 2048] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1))
    for k in (0, 1):  # the least values are small: their bits are spread again
        least = (least ^ least >> np.uint64(30)) * _MIX[k]
    return majority(*(least ^ least >> np.uint64(31)).reshape(BLOCKS, DRAWN).T)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets (ordered, not empty) is ``least`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b) - 1e-9:
        return False
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return same >= least * (len(a) + len(b) - same) - 1e-9


def sketches(df: DataFrame, text_col: str, id_col: str, width: int) -> DataFrame:
    """(id_col, text_key, node, size, fp) of every row; node stands for the set of shingles, fp is its wide fingerprint."""
    import xxhash

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)]).add("text_key", "long").add("node", "long").add("size", "long").add("fp", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                sets = [shingles(t, width) for t in part.column("__text").to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], "uint64").view("int64")
                size = pa.array([len(s) for s in sets], pa.int64())
                fp = pa.array([wide_fingerprint(s).view("int64") for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), size, fp], names=schema.names)
        release()

    return df.select(id_col, F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def candidates(nodes: DataFrame) -> DataFrame:
    """(u, v): every node (node, fp) that shares a block, and the least of those that have it. ``nodes`` is read several times."""
    keyed = nodes.select("node", F.posexplode("fp").alias("block", "key"))
    least = keyed.groupBy("block", "key").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    found = spread_join(keyed, least, ["block", "key"], "n", BLOCKS * nodes.count())
    return found.where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def set_links(members: list[tuple], least: float, forest: Forest) -> None:
    """Joins nodes (node, part, class, fp, hashes) of different classes whose sets are alike: those of one part, or those of two parts with each other."""
    members = sorted({m[0]: m for m in members}.values(), key=lambda m: (len(m[4]), m[0]))
    if len(members) < 2:
        return
    part, kind, sizes = (np.array(x) for x in ([m[1] for m in members], [m[2] for m in members], [len(m[4]) for m in members]))
    fps, two = np.stack([m[3] for m in members]), len(np.unique(part)) > 1
    for i, (u, p, c, _, a) in enumerate(members):
        end = int(np.searchsorted(sizes, len(a) / least + 1e-9, side="right"))
        near = (np.bitwise_count(fps[i + 1 : end] ^ fps[i]).sum(axis=1) <= FAR) & (kind[i + 1 : end] != c)
        if two:
            near &= part[i + 1 : end] != p
        for j in (np.flatnonzero(near) + i + 1).tolist():
            v, b = members[j][0], members[j][4]
            if forest.find(u) != forest.find(v) and forest.find(kind[j].item()) != forest.find(c) and alike(a, b, least):
                forest.link(u, v)
                forest.link(u, c)
                forest.link(v, kind[j].item())


def _pairs(found: list[tuple[int, int]]):
    pairs = np.array(found, "int64").reshape(-1, 2)
    for i in range(0, len(pairs), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[i : i + 65_536, k])) for k in (0, 1)], names=["u", "v"])


def _array(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).view("uint64")


def star_links(edges: DataFrame, sets: DataFrame, least: float, part: int = 256) -> DataFrame:
    """The edges (u, v) whose sets (node, fp, hashes) are alike. A star's leaves are dealt into parts, its centre goes to each. Both are read several times."""
    stars = edges.groupBy("v").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / F.lit(part)).cast("int"))
    own = sets.select(F.col("node").alias("u"), "fp", "hashes")
    leaves = spread_join(edges, stars, ["v"], "n", edges.count()).join(own, "u").select("v", F.pmod(F.xxhash64("u"), "parts").cast("int").alias("part"), F.lit(1).alias("leaf"), "u", "fp", "hashes")
    centres = stars.join(own.withColumnRenamed("u", "v"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("leaf"), F.col("v").alias("u"), "fp", "hashes")
    ordered = centres.unionByName(leaves).repartition("v", "part").sortWithinPartitions("v", "part", "leaf")

    def run(batches):
        centre, fp, hashes = None, None, None
        for batch in batches:
            found = []
            v, leaf, u = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for i in range(batch.num_rows):
                if not leaf[i]:
                    centre, fp, hashes = u[i], _array(batch.column(4), i).copy(), _array(batch.column(5), i).copy()
                elif v[i] == centre and np.bitwise_count(_array(batch.column(4), i) ^ fp).sum() <= FAR and alike(_array(batch.column(5), i), hashes, least):
                    found.append((u[i], centre))
            yield from _pairs(found)
        release()

    return ordered.mapInArrow(run, "u long, v long")


def class_links(members: DataFrame, sets: DataFrame, least: float, part: int = 512, hashes: int = 1 << 20) -> DataFrame:
    """(u, v): edges that connect members (root, node, class, size) of equal root and different classes whose sets (node, fp, hashes) are alike, directly or by a path.

    Classes of over ``part`` members, or ``hashes`` hashes, have parts of their own; the others of a root share parts. ``members`` is read several times.
    """
    n_parts = lambda n, size: F.ceil(F.greatest(n / F.lit(part), size / F.lit(hashes))).cast("int")
    classes = members.groupBy("root", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size")).withColumn("parts", n_parts(F.col("n"), F.col("size")))
    large, small = F.col("parts") > 1, F.col("parts") <= 1
    roots = classes.groupBy("root").agg(
        F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.when(large, F.struct("class", "parts")))).alias("large"),
        F.coalesce(n_parts(F.sum(F.when(small, F.col("n"))), F.sum(F.when(small, F.col("size")))), F.lit(0)).alias("shared"),
        F.count("*").alias("classes"),
    ).where("classes > 1")
    before = F.aggregate(F.filter("large", lambda c: c["class"] < F.col("class")), F.lit(0), lambda total, c: total + c["parts"])
    mine = F.get(F.filter("large", lambda c: c["class"] == F.col("class")), F.lit(0))["parts"]
    dealt = spread_join(members, roots, ["root"], "n", members.count()).withColumns({"mine": mine, "before": before, "all_large": F.aggregate("large", F.lit(0), lambda total, c: total + c["parts"])})
    hashed = F.xxhash64("node")
    dealt = dealt.withColumn("own", F.when(F.col("mine").isNotNull(), F.col("before") + F.pmod(hashed, "mine")).otherwise(F.col("all_large") + F.pmod(hashed, "shared")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all_large") + F.col("shared") - 1), lambda p: F.col("mine").isNull() | (p < F.col("before")) | (p >= F.col("before") + F.col("mine")))
    dealt = dealt.select("root", "node", "class", "own", others.alias("others")).join(sets.select("node", "fp", "hashes"), "node").withColumn("other", F.explode("others"))
    dealt = dealt.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "own", "class", "fp", "hashes")
    ordered = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def run(batches):
        forest, held, key = Forest(), [], None
        for batch in batches:
            root, lo, hi, node, own, kind = (batch.column(i).to_pylist() for i in range(6))
            for i in range(batch.num_rows):
                if (now := (root[i], lo[i], hi[i])) != key:
                    set_links(held, least, forest)
                    held, key = [], now
                held.append((node[i], own[i], kind[i], _array(batch.column(6), i), _array(batch.column(7), i)))
        set_links(held, least, forest)
        held.clear()
        yield from _pairs([(x, r) for x in list(forest.up) if (r := forest.find(x)) != x])
        release()

    return ordered.mapInArrow(run, "u long, v long")


def near_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = 0.8, width: int = 5) -> DataFrame:
    """(node, root, row) of every distinct set; row is (nameless, id, text_key) of its least row, those without an id last."""
    row = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), "text_key")
    rows = sketches(df, text_col, id_col, width)
    nodes = cut(rows.groupBy("node").agg(F.min(row).alias("row"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    edges = cut(candidates(nodes))
    near = components(edges)
    wanted = near.join(nodes, "node").select("node", "fp", F.col("row.id").alias("id"), F.col("row.text_key").alias("text_key"))
    texts = one_of_each(df.select(F.col(id_col).alias("own"), F.col(text_col).alias("__text")), wanted, "__text", "own", "inner").select("node", "fp", "__text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                sets = pa.array([shingles(t, width).view("int64") for t in part.column("__text").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], sets], names=["node", "fp", "hashes"])
        release()

    sets = cut(texts.mapInArrow(run, "node long, fp array<long>, hashes array<long>"))
    alike_stars = cut(star_links(edges.groupBy("u").agg(F.min("v").alias("v")), sets, least))
    classes = components(alike_stars)
    members = near.join(classes.withColumnRenamed("root", "class"), "node", "left").join(nodes.select("node", "size"), "node")
    members = cut(members.select("root", "node", F.coalesce("class", "node").alias("class"), "size"))
    found = components(alike_stars.unionByName(class_links(members, sets, least)))
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "row")


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = 0.8, width: int = 5) -> DataFrame:
    """One row of ``df`` for each group of near-duplicates: that of the least id."""
    kept = near_groups(df, text_col, id_col, least, width).groupBy("root").agg(F.min("row").alias("row"))
    return one_of_each(df, kept.select("row.id", "row.text_key"), text_col, id_col)
