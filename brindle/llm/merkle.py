"""A Merkle manifest of a dataset: a tree of digests over the rows of each source, a tree over the sources, and a proof for every row.

A leaf is the SHA-256 of a row's fields. Leaves of a source ascend by id; every ``ARITY`` consecutive nodes (the last run fewer) have a parent, up to the source's
subroot. The subroots, ordered by source, have the root above them in the same way.

Ranks. Rows are sorted into ranges by (source, id, leaf); a row's index is its place in its range plus the rows of its source in
earlier ranges, of which there is one count for each range and source. No source is ever sorted in one task.

Building is a combineByKey driven by events. The key is a parent (tree, level, index); a combiner is a partial parent, its child
digests by position. How many children make it whole follows from the size of its level, so the moment the last one arrives the combiner emits
the parent, and this is an event for the level above, in the same task. The map side runs over leaves in order, so only parents cut by the edge of a
range stay partial: the frontier. It is shuffled by key, the same combiner runs again and emits ancestors, and so on until no frontier is left, one
round a level at most. A task holds the path of open parents of its runs and its share of the frontier.

Proofs follow the links back. From the root down, each parent's run and the steps above it are joined to its children (16 of them), so that a run of
leaves ends up beside all the runs above it.

Defined results: a null field is ``-`` in the leaf, an empty text ``0:``; a null id is the least of its source, a null source a source of its own, the
first. Rows equal in id go by their leaf; repeated rows are leaves of their own, in any order, as they are equal. A row without an id isn't tampered with. Very long
texts are hashed whole. An empty table gives an empty result. Columns other than the id and the fields are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import scratch

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EVENTS = "whole boolean, tree string, level int, idx long, size long, pos array<int>, children array<binary>, digest binary"
_STEPS = "array<struct<pos:int,children:array<binary>>>"


def leaf(fields: list[Column]) -> Column:
    """SHA-256 in bytes of the fields, each with its length."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def lower_cased(id_col: Column, text: Column) -> tuple[Column, Column]:
    """The tampering that the proofs are tried on: whether a row is meant, and its text then."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False)), F.translate(text, _UPPER, _LOWER)


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def leaves(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, tree, leaf, other, row), written once: ``tree`` orders like the source, ``other`` is the leaf of the tampered row or null."""
    meant, text = lower_cased(F.col(id_col), F.col(text_col))
    changed = leaf([text if c == text_col else F.col(c) for c in fields])
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf([F.col(c) for c in fields]).alias("leaf"), F.when(meant, changed).alias("other"), F.monotonically_increasing_id().alias("row"))
    return _written(rows, "leaves")


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with idx, the number of earlier rows of its ``tree`` in the order ``by``, and size, the rows of that tree; written in order."""
    schema = T.StructType([*rows.schema, T.StructField("part", T.IntegerType(), False), T.StructField("place", T.LongType(), False)])
    at = rows.columns.index("tree")

    def run(batches):
        part, tree, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = np.empty(batch.num_rows, "int64")
            runs = batch.column(at).to_pylist()
            for i, t in enumerate(runs):
                if t != tree:
                    tree, n = t, 0
                places[i] = n
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, "int32")), pa.array(places)], names=schema.names)

    order = ["tree", *by]
    placed = _written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranges")
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    starts = counts.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "size": F.sum("n").over(Window.partitionBy("tree"))}).drop("n")
    indexed = placed.join(starts, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("place")).drop("part", "place", "before")
    return _written(indexed.sortWithinPartitions("tree", "idx"), "ranked")


def digest(children: list[bytes]) -> bytes:
    """A parent's digest: SHA-256 of its children's in hexadecimal."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


class Combiner:
    """Partial parents by key, each with the digests of its children by position."""

    def __init__(self):
        self.open: dict[tuple[str, int, int], tuple[int, dict[int, bytes]]] = {}

    def add(self, tree: str, level: int, idx: int, size: int, children: dict[int, bytes]):
        """Children of parent ``idx`` of ``level``, whose level has ``size`` nodes below it; yields the parents that are whole now, upwards."""
        while True:
            key = tree, level, idx
            _, have = self.open.setdefault(key, (size, {}))
            have.update(children)
            if len(have) < min(ARITY, size - ARITY * idx):
                return
            del self.open[key]
            run = [have[i] for i in range(len(have))]
            found, size = digest(run), -(-size // ARITY)
            yield tree, level, idx, size, run, found
            if size == 1:
                return
            level, idx, children = level + 1, idx // ARITY, {idx % ARITY: found}


def _combine(batches):
    """Events (partial parents; of these ``size`` is that of the level below) to whole parents (``size`` of their own level) and what stays partial."""
    own = Combiner()

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        kinds = [pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _EVENTS.split(", ")])

    for batch in batches:
        done = []
        for tree, level, idx, size, pos, children in zip(*[batch.column(c).to_pylist() for c in ("tree", "level", "idx", "size", "pos", "children")], strict=True):
            done += [(True, t, n, i, s, None, run, h) for t, n, i, s, run, h in own.add(tree, level, idx, size, dict(zip(pos, children, strict=True)))]
        if done:
            yield batch_of(done)
    left = [(False, *key, size, sorted(have), [have[i] for i in sorted(have)], None) for key, (size, have) in own.open.items()]
    for a in range(0, len(left), 4096):
        yield batch_of(left[a : a + 4096])


def parents(rows: DataFrame) -> DataFrame:
    """(tree, level, idx, size, children, digest) of every parent over ranked ``rows`` with ``leaf``; ``size`` nodes are in its level."""
    many = rows.where("size > 1")
    events = many.select("tree", F.lit(1).alias("level"), F.expr(f"idx div {ARITY}").alias("idx"), "size", F.array((F.col("idx") % ARITY).cast("int")).alias("pos"), F.array("leaf").alias("children"))
    rounds = []
    while True:
        now = _written(events.mapInArrow(_combine, _EVENTS), "parents")
        rounds.append(now.where("whole").drop("whole", "pos"))
        frontier = now.where("NOT whole").select(*events.columns)
        if frontier.isEmpty():
            break
        events = frontier.repartition("tree", "level", "idx")
    whole = rounds[0]
    for more in rounds[1:]:
        whole = whole.unionByName(more)
    return whole


def subroots(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest) of each tree's root: the parent that is alone in its level, or a lone leaf."""
    return nodes.where("size = 1").select("tree", "digest").unionByName(rows.where("size = 1").select("tree", F.col("leaf").alias("digest")))


def steps(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(tree, run, children, above, subroot): for each run of leaves its digests and the steps above its parent, nearest first.

    A step is a position and the run of digests it is a position of. ``tops`` has (tree, above, subroot) for each tree; a lone leaf
    has no run but an entry. Levels are joined from the root down.
    """
    highest = nodes.agg(F.max("level")).first()[0] or 0
    now = None
    for level in range(highest, 0, -1):
        here = nodes.where(F.col("level") == level)
        roots = here.where("size = 1").join(tops, "tree").select("tree", "idx", "children", "above", "subroot")
        if now is not None:
            own = here.where("size > 1").select("tree", F.col("idx").alias("__own"), F.expr(f"idx div {ARITY}").alias("idx"), F.col("children").alias("__children"))
            step = F.struct((F.col("__own") % ARITY).cast("int").alias("pos"), F.col("children").alias("children"))
            inner = own.join(now, ["tree", "idx"]).select("tree", F.col("__own").alias("idx"), F.col("__children").alias("children"), F.concat(F.array(step), "above").cast(_STEPS).alias("above"), "subroot")
            roots = roots.unionByName(inner)
        now = roots
    return now


@dataclass
class Manifest:
    """Ranked leaves of the sources and of the tree above them, the parents of both, and the root (None for an empty table)."""

    leaves: DataFrame
    nodes: DataFrame
    top_leaves: DataFrame
    top_nodes: DataFrame
    root: bytes | None


def build(df: DataFrame, **columns) -> Manifest:
    rows = ranked(leaves(df, **columns), ["id", "leaf", "row"])
    nodes = parents(rows)
    # One row for each source; the whole is one tree, ordered by source.
    found = _written(subroots(rows, nodes).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("digest").alias("leaf")), "subroots")
    top = ranked(found, ["source"])
    top_nodes = parents(top)
    root = subroots(top, top_nodes).first()
    return Manifest(rows, nodes, top, top_nodes, bytes(root["digest"]) if root else None)


def _others(run: list[bytes], pos: int) -> str:
    return "".join([c.hex() for i, c in enumerate(run) if i != pos])


def _prove(root: bytes, schema: T.StructType):
    def run(batches):
        for batch in batches:
            out = []
            for children, above, subroot, group in zip(*[batch.column(c).to_pylist() for c in ("children", "above", "subroot", "group")], strict=True):
                tail, folded = "".join([_others(s["children"], s["pos"]) for s in above]), {}

                def fold(h, above=above, folded=folded):
                    """From the run's parent to the root; equal digests of one run fold alike."""
                    if h not in folded:
                        now = h
                        for s in above:
                            now = digest([now if i == s["pos"] else c for i, c in enumerate(s["children"])])
                        folded[h] = now
                    return folded[h]

                for x in group:
                    pos, own = x["pos"], x["leaf"] if x["other"] is None else x["other"]
                    first = _others(children, pos) if children else ""
                    up = fold(digest([own if i == pos else c for i, c in enumerate(children)]) if children else own)
                    out.append((x["id"], x["leaf"].hex(), subroot.hex(), root.hex(), hashlib.sha256((first + tail).encode()).hexdigest(), up.hex(), up == root))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column("group").type.value_type.field("id").type), *map(pa.array, columns[1:])], names=schema.names)

    return run


def proofs(found: Manifest, spark: SparkSession, id_col: str = "doc_id") -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) for every row: the digest of its proof, and the root recomputed from the tampered row."""
    schema = T.StructType([T.StructField(id_col, found.leaves.schema["id"].dataType)])
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema.add(c, T.StringType(), False)
    schema.add("verified", T.BooleanType(), False)
    if found.root is None:
        return spark.createDataFrame([], schema)
    none = F.array().cast(_STEPS)
    top = found.top_leaves.select(F.col("source").alias("tree"), F.col("leaf").alias("subroot"), "idx", "size")
    tops = top.where("size = 1").select("tree", none.alias("above"), "subroot")
    over = steps(found.top_nodes, spark.createDataFrame([("", [], found.root)], f"tree string, above {_STEPS}, subroot binary"))
    if over is not None:
        run = over.select(F.col("idx").alias("run"), "children", F.col("above").alias("__above"))
        step = F.struct((F.col("idx") % ARITY).cast("int").alias("pos"), F.col("children").alias("children"))
        joined = top.where("size > 1").withColumn("run", F.expr(f"idx div {ARITY}")).join(run, "run")
        tops = tops.unionByName(joined.select("tree", F.concat(F.array(step), "__above").cast(_STEPS).alias("above"), "subroot"))
    tops = _written(tops, "tops")
    lone = found.leaves.where("size = 1").select("tree").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("array<binary>").alias("children"), "above", "subroot")
    runs = steps(found.nodes, tops)
    runs = lone if runs is None else runs.unionByName(lone)
    entry = F.struct((F.col("idx") % ARITY).cast("int").alias("pos"), "id", "leaf", "other")
    groups = found.leaves.groupBy("tree", F.expr(f"idx div {ARITY}").alias("idx")).agg(F.collect_list(entry).alias("group"))  # ARITY at most
    return groups.join(runs, ["tree", "idx"]).select("children", "above", "subroot", "group").mapInArrow(_prove(found.root, schema), schema)


def manifest(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The proofs of every row of ``df``, see ``proofs``."""
    return proofs(build(df, id_col=id_col, source_col=source_col, text_col=text_col, fields=fields), df.sparkSession, id_col)


def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _sql() -> str:
    own = " || ".join(_field(c) for c in FIELDS)
    changed = " || ".join(_field(f"translate(text, '{_UPPER}', '{_LOWER}')" if c == "text" else c) for c in FIELDS)
    # A byte is taken in, then eight bits are shifted out (-1 stands for a shift).
    steps_of = "flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps_of}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT)"
    up = "SELECT tree, level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE size > 1 GROUP BY tree, level, idx // 16, size"
    fold = "SELECT doc_id, tree, level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(part, '' ORDER BY i)) FROM (SELECT f.*, n.idx AS i, CASE WHEN n.idx = f.idx THEN cur ELSE h END AS part FROM {0} f JOIN {1} n ON n.tree = f.tree AND n.level = f.level AND n.idx // 16 = f.idx // 16 WHERE f.size > 1) GROUP BY doc_id, tree, level, idx, size"
    beside = "n.size > 1 AND n.idx // 16 = (l.idx >> (4 * n.level)) // 16 AND n.idx <> l.idx >> (4 * n.level)"
    return f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({own}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({changed}) ELSE sha256({own}) END AS other,
   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size FROM documents),
 nodes AS (SELECT tree, 0 AS level, idx, size, leaf AS h FROM l UNION ALL {up.format('nodes')}),
 subs AS MATERIALIZED (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM nodes WHERE size = 1),
 tops AS (SELECT '' AS tree, 0 AS level, idx, size, subroot AS h FROM subs UNION ALL {up.format('tops')}),
 folds AS (SELECT doc_id, tree, 0 AS level, idx, size, other AS cur FROM l UNION ALL {fold.format('folds', 'nodes')}),
 over AS (SELECT f.doc_id, '' AS tree, 0 AS level, s.idx, s.size, f.cur FROM folds f JOIN subs s ON s.source = f.tree WHERE f.size = 1 UNION ALL {fold.format('over', 'tops')}),
 beside AS (SELECT doc_id, 0 AS leg, n.level, n.idx, h FROM l JOIN nodes n ON n.tree = l.tree AND {beside}
   UNION ALL SELECT d.doc_id, 1, n.level, n.idx, h FROM l d JOIN subs l ON l.source = d.tree JOIN tops n ON {beside}),
 proofs AS (SELECT doc_id, string_agg(h, '' ORDER BY leg, level, idx) AS path FROM beside GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(coalesce(p.path, '')) AS proof_sha256, o.cur AS folded_root, o.cur = t.h AS verified
FROM l JOIN subs s ON s.source = l.tree JOIN (SELECT h FROM tops WHERE size = 1) t ON true JOIN (SELECT doc_id, cur FROM over WHERE size = 1) o ON o.doc_id = l.doc_id LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""


#: The same rows by DuckDB, from a table documents with distinct ids.
SQL = _sql()
