"""Text formats: image, keypoint, query, segment and result lists, level and word-tree files, matrices, labels and feature files.

Line formats are read line by line. Formats whose meaning depends on the position in the file are read a file at a time; they are for
exchange, and the tables they become are kept as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.sources.shared import cut


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("t"), "value")


def _field(i: int, kind: str) -> Column:
    return F.element_at("t", i).cast(kind)


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """(fid, path) of lines ``fid path``."""
    return _lines(spark, path).select(_field(1, "int").alias("fid"), F.element_at("t", 2).alias("path"))


def keypoint_info(spark: SparkSession, path: str) -> DataFrame:
    """(kp_id, fid, x, y, scl, ori) of lines with at least six columns; what follows is ignored."""
    names = [("kp_id", "long"), ("fid", "int"), ("x", "double"), ("y", "double"), ("scl", "double"), ("ori", "double")]
    return _lines(spark, path).select(*[_field(i + 1, kind).alias(n) for i, (n, kind) in enumerate(names)])


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """(first, path) of lines ``type path``, ``id path`` or ``path`` (first is null)."""
    return _lines(spark, path).select(F.when(F.size("t") > 1, F.element_at("t", 1)).alias("first"), F.element_at("t", -1).alias("path"))


def segment_list(spark: SparkSession, path: str) -> DataFrame:
    """(kp_id, fid, segs) of lines ``kp_id fid n seg...``."""
    return _lines(spark, path).select(_field(1, "long").alias("kp_id"), _field(2, "int").alias("fid"), F.slice("t", F.lit(4), _field(3, "int")).cast("array<int>").alias("segs"))


def result_detail(spark: SparkSession, path: str) -> DataFrame:
    """(qfid, rank, fid, sim) of lines ``qfid n (fid sim)...``, worst first."""
    rows = _lines(spark, path).select(_field(1, "long").alias("qfid"), _field(2, "int").alias("n"), "t").where("n > 0")
    at = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    item = lambda k: F.element_at("t", (F.lit(3 + k) + 2 * F.col("i")).cast("int"))
    return at.select("qfid", (F.col("n") - F.col("i")).alias("rank"), item(0).cast("long").alias("fid"), item(1).cast("double").alias("sim"))


def write_result_detail(results: DataFrame, path: str) -> None:
    entry = F.concat_ws(" ", F.col("fid").cast("string"), F.format_string("%.6f", "sim"))
    lists = results.groupBy("qfid").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), entry.alias("e")))).alias("l"))
    lists.select(F.concat_ws(" ", F.col("qfid").cast("string"), F.col("n").cast("string"), F.array_join(F.col("l")["e"], " "))).write.text(path)


def write_segments(segments: DataFrame, path: str) -> None:
    segs = F.col("segs").cast("array<string>")
    segments.select(F.rtrim(F.concat_ws(" ", F.col("kp_id").cast("string"), F.col("fid").cast("string"), F.size("segs").cast("string"), F.array_join(segs, " ")))).write.text(path)


def write_lines(df: DataFrame, path: str, separator: str = " ") -> None:
    """Columns side by side, as in image, keypoint and query lists."""
    df.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in df.columns])).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def _whole(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that ``parse`` makes of each file's text, after the columns of the folders it lies in (``fid=3``), as strings."""
    files = spark.read.text(path, wholetext=True)
    folders = [c for c in files.columns if c != "value"]
    names = folders + [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for f in frames:
            for text, *own in zip(f["value"], *(f[c] for c in folders), strict=True):
                yield pd.DataFrame([(*own, *row) for row in parse(text)], columns=names)

    files = files.select("value", *[F.col(c).cast("string") for c in folders])
    return files.mapInPandas(run, ", ".join([f"`{c}` string" for c in folders] + [schema]))


def write_positional(lines: DataFrame, path: str, *by: str) -> None:
    """A file whose meaning depends on the position: column ``line`` in the order of ``by``, written by one task as a stream."""
    lines.select("line", *by).coalesce(1).sortWithinPartitions(*by).select("line").write.text(path)


def level_file(text: str) -> Iterator[tuple]:
    """(kind, a, b) of a level cluster file: edge (parent, children), size (cluster, points), point (position, cluster)."""
    t = list(map(int, text.split()))
    n = t[0]
    yield from (("edge", t[1 + 2 * i], t[2 + 2 * i]) for i in range(n))
    at = 1 + 2 * n
    m = t[at]
    yield from (("size", t[at + 1 + 2 * i], t[at + 2 + 2 * i]) for i in range(m))
    yield from (("point", i, c) for i, c in enumerate(t[at + 1 + 2 * m :]))


def read_level_file(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, level_file, "kind string, a long, b long")


def format_level_file(edges: list[tuple[int, int]], sizes: list[tuple[int, int]], points: list[int]) -> str:
    lines = [str(len(edges)), *(f"{a} {b}" for a, b in edges), str(len(sizes)), *(f"{a} {b}" for a, b in sizes), *map(str, points)]
    return "\n".join(lines) + "\n"


def words_file(text: str, weighted: bool = False) -> Iterator[tuple]:
    """(node_id, is_leaf, npoints, idf, sons, tfs, center) of a word tree; inner nodes' sons are their child range."""
    t = iter(text.split())
    _, nodes, leaves, dim = (int(next(t)) for _ in range(4))
    for k in range(nodes):
        node, points = int(next(t)), int(next(t))
        idf = float(next(t)) if weighted else None
        sons, tfs = [], []
        for _ in range(int(next(t))):
            sons.append(int(next(t)))
            if weighted:
                tfs.append(float(next(t)))
        yield node, k >= nodes - leaves, points, idf, sons, tfs, [float(next(t)) for _ in range(dim)]


def read_words_file(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return _whole(spark, path, lambda text: words_file(text, weighted), "node_id long, is_leaf boolean, npoints long, idf double, sons array<long>, tfs array<double>, center array<double>")


def format_words_file(rows: list[tuple], points: int, weighted: bool = False) -> str:
    """The file of rows as ``words_file`` yields them."""
    leaves, dim = sum(r[1] for r in rows), len(rows[0][6]) if rows else 0
    lines = [f"{points} {len(rows)} {leaves} {dim}"]
    for node, _, n, idf, sons, tfs, center in rows:
        pairs = " ".join(f"{s} {t:.6f}" for s, t in zip(sons, tfs, strict=True)) if weighted else " ".join(map(str, sons))
        lines.append(" ".join(x for x in (f"{node} {n}", f"{idf:.6f}" if weighted else "", str(len(sons)), pairs, " ".join(f"{c:.6f}" for c in center)) if x))
    return "\n".join(lines) + "\n"


def lowe_features(text: str) -> Iterator[tuple]:
    """(x, y, scl, ori, a, b, c, vec) of ``n d`` and for each feature ``y x scale orientation`` and its descriptor."""
    t = iter(map(float, text.split()))
    n, d = int(next(t)), int(next(t))
    for _ in range(n):
        y, x, scl, ori = (next(t) for _ in range(4))
        yield x, y, scl, ori, 0.0, 0.0, 0.0, [next(t) for _ in range(d)]


def oxford_features(text: str) -> Iterator[tuple]:
    """The same of ``d``, ``n`` and for each feature ``x y a b c`` and its descriptor."""
    t = iter(map(float, text.split()))
    d, n = int(next(t)), int(next(t))
    for _ in range(n):
        x, y, a, b, c = (next(t) for _ in range(5))
        yield x, y, 0.0, 0.0, a, b, c, [next(t) for _ in range(d)]


def read_features(spark: SparkSession, path: str, kind: str = "lowe") -> DataFrame:
    parse = {"lowe": lowe_features, "oxford": oxford_features}[kind]
    return _whole(spark, path, parse, "x double, y double, scl double, ori double, a double, b double, c double, vec array<double>")


def format_features(rows: list[tuple], kind: str = "lowe") -> str:
    """A feature file of rows as the readers yield them; Lowe descriptors are whole numbers, twenty a line."""
    d = len(rows[0][7]) if rows else 0
    if kind == "oxford":
        return f"{d}\n{len(rows)}\n" + "".join(" ".join(f"{v:f}" for v in (x, y, a, b, c, *vec)) + "\n" for x, y, _, _, a, b, c, vec in rows)
    out = [f"{len(rows)} {d}\n"]
    for x, y, scl, ori, _, _, _, vec in rows:
        out.append(" ".join(f"{v:f}" for v in (y, x, scl, ori)))
        for i in range(0, d, 20):
            out.append("\n " + " ".join(str(int(v)) for v in vec[i : i + 20]))
        out.append("\n")
    return "".join(out)


def _tokens(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(p, v) of the values of a file, or of a folder of parts in the order of their names, numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("part"), F.split(F.btrim("value", F.lit(" \n\r\t")), r"\s+").alias("v")).where("v[0] <> ''")
    # Only the sizes go to the one task that adds them up.
    sizes = whole.select("part", F.size("v").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return whole.join(F.broadcast(sizes), "part").select("before", F.posexplode("v").alias("p", "v")).select((F.col("before") + F.col("p")).alias("p"), F.col("v").cast(kind).alias("v"))


def write_level(assigned: DataFrame, prefix: str, count: int = 1 << 18) -> None:
    """A level (kp_id, cid, parent) as the three sections of a level file beside each other, each a folder of ordered parts of about ``count`` values.

    _edges has parent and number of children, _sizes cluster and number of points, in their order, and _points the cluster of each point in the order of kp_id.
    """
    pairs = {"edges": assigned.groupBy("parent").agg(F.countDistinct("cid").alias("n")), "sizes": assigned.groupBy("cid").agg(F.count("*").alias("n"))}
    for name, df in pairs.items():
        in_order(df, df.columns[0], count=count).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).write.text(f"{prefix}_{name}")
    in_order(assigned.select("kp_id", "cid"), "kp_id", count=count).select(F.col("cid").cast("string")).write.text(f"{prefix}_points")


def read_level(spark: SparkSession, prefix: str) -> DataFrame:
    """The rows of ``read_level_file`` from the folders of ``write_level``."""

    def pairs(name, kind):
        t = _tokens(spark, f"{prefix}_{name}", "long").groupBy(F.expr("p div 2").alias("i")).agg(F.max(F.when(F.col("p") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("p") % 2 == 1, F.col("v"))).alias("b"))
        return t.select(F.lit(kind).alias("kind"), "a", "b")

    points = _tokens(spark, f"{prefix}_points", "long").select(F.lit("point").alias("kind"), F.col("p").cast("long").alias("a"), F.col("v").alias("b"))
    return pairs("edges", "edge").unionByName(pairs("sizes", "size")).unionByName(points)


def sparse_matrix(spark: SparkSession, prefix: str, scaling: str = "tfn") -> DataFrame:
    """(doc_id, word_id, val) of a compressed-column matrix: _col_ccs, _row_ccs and _<scaling>_nz beside each other, each a file or a folder of parts in the order of their names."""

    tokens = lambda name, kind: _tokens(spark, f"{prefix}_{name}", kind)
    starts = tokens("col_ccs", "long").select(F.col("p").alias("doc_id"), F.col("v").alias("a"))
    ends = starts.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    places = starts.join(ends, "doc_id").where("b > a").select("doc_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("p"))
    rows, values = tokens("row_ccs", "long").withColumnRenamed("v", "word_id"), tokens(f"{scaling}_nz", "double").withColumnRenamed("v", "val")
    return places.join(rows, "p").join(values, "p").select("doc_id", "word_id", "val")


def in_order(df: DataFrame, *by: str, count: int = 1 << 18) -> DataFrame:
    """``df`` in partitions that follow the order of ``by``, of about ``count`` rows each, written once."""
    df = cut(df)
    return cut(df.repartitionByRange(max(1, -(-df.count() // count)), *by).sortWithinPartitions(*by))


def before(ordered: DataFrame, column: str = "1") -> DataFrame:
    """(part, before): what the partitions before each one hold of a column's sum."""
    sums = ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.expr(f"sum({column})").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # over partitions


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with the rank of each row in the order of ``by``, from 0."""
    ordered = in_order(df, by)
    at = ordered.withColumns({"part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return at.join(F.broadcast(before(ordered)), "part").withColumn(name, F.col("before") + F.col("__at")).drop("part", "before", "__at")


def write_sparse_matrix(cells: DataFrame, n_words: int, prefix: str, count: int = 1 << 18) -> None:
    """Writes cells (doc_id, word_id, val) as the files of ``format_sparse_matrix``, each a folder of parts of about ``count`` values."""
    spark, ordered = cells.sparkSession, in_order(cells.select("doc_id", "word_id", F.col("val").cast("double").alias("val")), "doc_id", "word_id", count=count)
    last, n = ordered.agg(F.max("doc_id"), F.count("*")).first()
    n_docs = (last or 0) + 1
    sizes = spark.range(n_docs + 1).withColumnRenamed("id", "doc_id").join(ordered.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))
    columns = in_order(sizes, "doc_id", count=count)
    within = Window.partitionBy("part").orderBy("doc_id")
    at = columns.withColumn("part", F.spark_partition_id()).join(F.broadcast(before(columns, "n")), "part")
    starts = at.select("doc_id", (F.col("before") + F.sum("n").over(within) - F.col("n")).alias("start"))
    for name, column in (("row_ccs", ordered.select(F.col("word_id").cast("string"))), ("tfn_nz", ordered.select(F.col("val").cast("string"))), ("col_ccs", in_order(starts, "doc_id", count=count).select(F.col("start").cast("string")))):
        column.write.text(f"{prefix}_{name}")
    spark.createDataFrame([(f"{n_words} {n_docs} {n}",)], "value string").coalesce(1).write.text(f"{prefix}_dim")


def format_sparse_matrix(cells: list[tuple[int, int, float]], n_words: int, n_docs: int) -> dict[str, str]:
    """Texts of the files _dim, _col_ccs, _row_ccs and _tfn_nz."""
    cells = sorted(cells)
    starts, at = [], 0
    for d in range(n_docs + 1):
        while at < len(cells) and cells[at][0] < d:
            at += 1
        starts.append(at)
    column = lambda xs: "\n".join(map(str, xs)) + "\n"
    return {"dim": f"{n_words} {n_docs} {len(cells)}\n", "col_ccs": column(starts), "row_ccs": column(w for _, w, _ in cells), "tfn_nz": column(repr(float(v)) for _, _, v in cells)}


def dense_matrix(spark: SparkSession, path: str, points: str = "rows") -> DataFrame:
    """(doc_id, vec) of ``rows cols`` and cells; points are its rows or its columns."""

    def parse(text):
        t = text.split()
        n, m = int(t[0]), int(t[1])
        v = list(map(float, t[2:]))
        return ((i, v[i * m : i * m + m]) for i in range(n)) if points == "rows" else ((j, v[j::m]) for j in range(m))

    return _whole(spark, path, parse, "doc_id long, vec array<double>")


def write_dense_matrix(points: DataFrame, prefix: str, by: str, vec: str = "vec", count: int = 1 << 18) -> None:
    """Writes the vectors of ``points`` in the order of ``by`` (null last) as _dim (``rows cols``) and _rows, a folder of ordered parts of about ``count`` values with a point a line.

    A null vector is a line ``-``, a null value ``null``.
    """
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size(vec)), F.lit(0))).first()
    line = F.coalesce(F.array_join(F.col(vec).cast("array<string>"), " ", "null"), F.lit("-"))
    # Points of one id may fill several parts.
    order = F.col("by").asc_nulls_last(), F.xxhash64("line")
    parts = max(1, -(-n * max(1, width) // count))
    points.select(F.col(by).alias("by"), line.alias("line")).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("line").write.text(f"{prefix}_rows")
    points.sparkSession.createDataFrame([(f"{n} {max(0, width)}",)], "value string").coalesce(1).write.text(f"{prefix}_dim")


def dense_rows(spark: SparkSession, prefix: str) -> DataFrame:
    """(doc_id, vec) of what ``write_dense_matrix`` has written; a task reads a part at a time."""
    lines = F.split("value", "\n")
    whole = spark.read.text(f"{prefix}_rows", wholetext=True).select(F.col("_metadata.file_name").alias("part"), F.slice(lines, F.lit(1), F.size(lines) - 1).alias("lines"))
    # Only the sizes go to the one task that adds them up.
    sizes = whole.select("part", F.size("lines").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = whole.join(F.broadcast(sizes), "part").select("before", F.posexplode("lines").alias("at", "line"))
    values = F.transform(F.filter(F.split("line", " "), lambda x: x != ""), lambda x: x.try_cast("double"))
    return rows.select((F.col("before") + F.col("at")).alias("doc_id"), F.when(F.col("line") != "-", values).alias("vec"))


def value_column(spark: SparkSession, path: str, name: str = "label") -> DataFrame:
    """(doc_id, name) of a label, seeding or prior file: ``n 1`` and a value a line."""
    return _whole(spark, path, lambda text: enumerate(map(float, text.split()[2:])), f"doc_id long, {name} double")


def format_value_column(values: list) -> str:
    return f"{len(values)} 1\n" + "".join(f"{v}\n" for v in values)


def format_clustering(clusters: list[int], names: list[str]) -> str:
    return f"{len(clusters)}\n" + "".join(f"{c}\t{n}\n" for c, n in zip(clusters, names, strict=True))
