"""Connected components of an edge list by alternating stars; no adjacency list is ever in one task.

The centre of a star may have a third of all edges: ``spread_join`` leaves such edges where they are. Rounds of up to ``SMALL`` edges
lie in few partitions and broadcast what they join: a round's tasks and files follow its edges, not the session's partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut
from brindle.operators.joins import spread_join

#: Edges of a round that is joined by broadcast, and of one of its partitions (eight at least).
SMALL, PART = 1 << 18, 1 << 15


def _joined(rows: DataFrame, least: DataFrame, n: int, total: int) -> DataFrame:
    """``rows`` with the one row of ``least`` of their u; ``total`` is the number of ``rows``, or more."""
    return rows.join(F.broadcast(least), "u") if n <= SMALL else spread_join(rows, least, ["u"], "n", total)


def _packed(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows in few partitions if it is small."""
    return df.coalesce(max(8, -(-n // PART))) if n <= SMALL else df


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours joined to the least of the node and its neighbours; ``n`` edges at most."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _packed(_joined(both, least, n, 2 * n).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours joined to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _joined(down, least, n, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _packed(moved.unionByName(_packed(least.select("u", F.col("m").alias("v")), n)).distinct(), n)


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns u, v; u <> v), where root is the least node reachable.

    A node without an edge isn't listed. Nulls in u or v are no edges. Each round is written to the shared folder, so that
    a lost executor repeats one round at most. Rounds go on until nothing changes; their number grows with the logarithm of the largest component.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while (new := _mark(now)) != mark and new[0]:
        mark = new
        now = cut(_small(cut(_large(_packed(now, new[0]), new[0])), new[0]))
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
