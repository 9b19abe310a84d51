"""SimHash near-duplicates by pigeonhole blocks.

The 64 bits are split into six blocks. Two fingerprints that differ in three bits at most leave three of the
six blocks untouched, so they share one of the twenty keys made of three blocks (about 32 bits, which keeps
buckets small at billions of fingerprints). Equal fingerprints are one entry. A bucket's entries are compared
by Hamming distance in arrays and leave a spanning forest of their links, never all pairs. A bucket of over
``bucket`` entries is dealt into parts of about that size, and every pair of parts is a task's work of its own, so no
link is lost and no bucket sits in one task. The texts of a fingerprint, the fingerprints of a bucket and of a component
may be a third of all: they are joined by ``spread_join``.

Defined results: a text without words (null, empty, white space) has fingerprint zero and links like any
other. Rows without a doc_id take part; a component whose rows all lack one has a null component_id. Repeated rows give repeated
rows. An empty table gives an empty result. Very long texts are hashed whole, a megabyte at a time. Other columns are ignored by
``near_duplicates`` and pass through ``near_dedup``.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import cut, one_of_each, slices
from brindle.llm.components import components
from brindle.operators.joins import spread_join

SEED = 42
BLOCKS, SHARED = 6, 3
_PIECE = 1 << 20


def _word_runs(data: bytes):
    """Lists of words of a text, a run of about a megabyte at a time."""
    at = 0
    while len(data) - at > _PIECE:
        end = at + _PIECE
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the XXH64 hashes of the word shingles, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, n, carry = np.zeros(64, "int64"), 0, []
    for words in _word_runs((text or "").encode().lower()):
        words = carry + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[: len(words) - width].tolist()]
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], ">u8")
            for i in range(0, len(hashes), 65_536):
                ones += np.unpackbits(hashes[i : i + 65_536].view("u1").reshape(-1, 8), axis=1).sum(0, dtype="int64")
            n += len(hashes)
        carry = words[max(0, len(words) - width + 1) :]
    if not n and carry:
        return digest(b" ".join(carry), SEED)
    return int(np.packbits(2 * ones > n).view(">u8")[0]) if n else 0


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, text_key, fp): the xxhash64 of the text, and its fingerprint as a signed long."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)]).add("text_key", "long").add("fp", T.LongType(), False)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                fp = np.array([fingerprint(t) for t in part.column("__text").to_pylist()], "uint64").view("int64")
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(fp)], names=schema.names)

    return df.select(id_col, F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def block_masks() -> list[int]:
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, c) for c in combinations(block, SHARED)]


class Forest:
    """Union-find over a task's fingerprints; the least of a set is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def bucket_links(values: np.ndarray, distance: int, forest: Forest) -> None:
    """Joins the fingerprints of one bucket that differ in ``distance`` bits at most, 256 rows against all at a time."""
    for i in range(0, len(values), 256):
        rows = values[i : i + 256]
        near = np.bitwise_count(rows[:, None] ^ values[None, i:]) <= distance
        for r, c in zip(*np.nonzero(near), strict=True):
            if c > r:
                forest.link(int(rows[r]), int(values[i + c]))


def links(fps: DataFrame, distance: int = 3, bucket: int = 2048) -> DataFrame:
    """(u, v): edges that connect the distinct fingerprints (column fp) that are linked, directly or by a path. ``fps`` is read several times."""
    if distance != BLOCKS - SHARED:
        raise ValueError(f"the blocks are made for a distance of {BLOCKS - SHARED}")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(k).cast("byte").alias("combo"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("part")) for k, m in enumerate(block_masks())])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.combo", "k.part")
    sizes = keyed.groupBy("combo", "part").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    dealt = (
        spread_join(keyed, sizes, ["combo", "part"], "n", len(block_masks()) * fps.count())
        .withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("combo", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    ordered = dealt.repartition("combo", "part", "lo", "hi").sortWithinPartitions("combo", "part", "lo", "hi")

    def run(batches):
        forest, held, key = Forest(), [], None
        for batch in batches:
            names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            fp = batch.column(4).to_numpy(zero_copy_only=False).view("uint64")
            if not len(fp):
                continue
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in names], axis=0)) + 1
            for a, b in zip([0, *change], [*change, len(fp)], strict=True):
                now = tuple(int(x[a]) for x in names)
                if now != key and held:
                    bucket_links(np.concatenate(held), distance, forest)
                    held = []
                key = now
                held.append(fp[a:b])
        if held:
            bucket_links(np.concatenate(held), distance, forest)
        pairs = [(x, forest.find(x)) for x in forest.up]
        pairs = np.array([p for p in pairs if p[0] != p[1]], "uint64").reshape(-1, 2).view("int64")
        for i in range(0, len(pairs), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[i : i + 65_536, k])) for k in (0, 1)], names=["u", "v"])

    return ordered.mapInArrow(run, "u long, v long")


def near_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = 3) -> tuple[DataFrame, DataFrame]:
    """(id_col, text_key, fp) of every row, and (fp, root, component_id, row) of every distinct fingerprint.

    row is (nameless, id, text_key) of the fingerprint's least row, those without an id last.
    """
    rows = cut(fingerprints(df, text_col, id_col))
    row = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), "text_key")
    distinct = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.min(row).alias("row")))
    roots = components(links(distinct.select("fp"), distance))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", "row", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    return rows, spread_join(placed, least, ["root"], "n", distinct.count()).select("fp", "root", "component_id", "row")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``df``."""
    rows, groups = near_groups(df, text_col, id_col, distance)
    total, per_fp = rows.count(), rows.groupBy("fp").agg(F.count("*").alias("n"))
    found = spread_join(rows, groups.join(per_fp, "fp").select("fp", "component_id", "n"), ["fp"], "n", total)
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", distance: int = 3) -> DataFrame:
    """One row of ``df`` for each near-duplicate group: that of the least id, and of its texts that of the least hash.

    Of a group without any id, one row stays. ``wide_simhash`` has the like for a set similarity.
    """
    kept = near_groups(df, text_col, id_col, distance)[1].groupBy("root").agg(F.min("row").alias("row"))
    return one_of_each(df, kept.select("row.id", "row.text_key"), text_col, id_col)
