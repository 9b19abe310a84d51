import struct

import numpy as np
from pyarrow import fs

from brindle.functions import sift
from brindle.operators import image_features
from brindle.sources import records, text
from brindle.sources.shared import scratch


def put(uri, name, data):
    """Writes one small file into a folder and returns its path."""
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(data.encode())
    return f"{uri}/{name}"


def test_vector_files(spark):
    x = np.random.default_rng(0).normal(size=(257, 5)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "kp_id long, vec array<float>").repartition(4)
    folder = scratch(spark, "v")
    assert records.write(df, folder) == 257
    for rows in (7, 100, 1000):
        got = records.read(spark, folder, rows=rows, batch=13).orderBy("kp_id").collect()
        assert [r.kp_id for r in got] == list(range(257)) and np.array_equal(np.array([r.vec for r in got], "f4"), x)
    whole = scratch(spark, "whole")
    assert records.merge(folder, whole) == 257
    data = open(whole.removeprefix("file://"), "rb").read()
    assert struct.unpack("<3I", data[:12]) == (4, 257, 5) and data[12:] == x.tobytes()
    assert records.read(spark, whole, rows=50).count() == 257


def test_small_elements_and_damage(spark):
    df = spark.createDataFrame([(0, [1, 65535]), (1, [2, 3])], "kp_id long, vec array<int>")
    folder = scratch(spark, "u")
    records.write(df.coalesce(1), folder, element="<u2")
    assert [r.vec for r in records.read(spark, folder).orderBy("kp_id").collect()] == [[1.0, 65535.0], [2.0, 3.0]]
    reader = records.RecordReader({"path": folder})
    part = reader.partitions()[0]
    open(part.path, "r+b").truncate(14)
    try:
        list(reader.read(part))
        raise AssertionError("a short file was read")
    except OSError:
        pass


def test_feature_files(spark):
    for layout, names, width in (("features", "x y scl ori contr rpc", 128), ("pca_features", "x y scl ori", 36)):
        names = names.split()
        rows = [(i, 7, i, *[float(i + k) for k in range(len(names))], [float(i)] * width) for i in range(9)]
        df = spark.createDataFrame(rows, f"kp_id long, fid long, sid int, {', '.join(f'{n} double' for n in names)}, vec array<double>")
        folder = scratch(spark, layout)
        assert records.write(df, folder, layout) == 9
        got = records.read(spark, folder, layout, rows=2).orderBy("kp_id").collect()
        assert [tuple(r)[:-1] for r in got] == [r[:-1] for r in rows] and got[3].vec == [3.0] * width


def test_text_lists(spark):
    folder = scratch(spark, "t")
    put(folder, "info", "0 5 1.5 2 3 4 0.1 9\n1 6 2 2 3 4\n")
    assert [tuple(r) for r in text.keypoint_info(spark, f"{folder}/info").orderBy("kp_id").collect()] == [(0, 5, 1.5, 2, 3, 4), (1, 6, 2, 2, 3, 4)]
    put(folder, "queries", "7 a/b.jpg\nc.jpg\n")
    assert {tuple(r) for r in text.query_list(spark, f"{folder}/queries").collect()} == {("7", "a/b.jpg"), (None, "c.jpg")}
    segs = spark.createDataFrame([(0, 1, [2, 3]), (1, 1, [])], "kp_id long, fid int, segs array<int>")
    text.write_segments(segs, f"{folder}/segs")
    assert {(r.kp_id, tuple(r.segs)) for r in text.segment_list(spark, f"{folder}/segs").collect()} == {(0, (2, 3)), (1, ())}
    res = spark.createDataFrame([(1, 1, 10, 0.5), (1, 2, 11, 0.25), (2, 1, 12, 1.0)], "qfid long, rank int, fid long, sim double")
    text.write_result_detail(res, f"{folder}/detail")
    assert "1 2 11 0.250000 10 0.500000" in [r.value for r in spark.read.text(f"{folder}/detail").collect()]
    assert {tuple(r) for r in text.result_detail(spark, f"{folder}/detail").collect()} == {tuple(r) for r in res.collect()}


def test_positional_files(spark):
    folder = scratch(spark, "p")
    put(folder, "level", text.format_level_file([(0, 2)], [(0, 2), (1, 1)], [0, 1, 0]))
    got = {tuple(r) for r in text.read_level_file(spark, f"{folder}/level").collect()}
    assert got == {("edge", 0, 2), ("size", 0, 2), ("size", 1, 1), ("point", 0, 0), ("point", 1, 1), ("point", 2, 0)}
    for weighted in (False, True):
        rows = [(0, False, 3, 0.0 if weighted else None, [1, 2], [0.0, 0.0] if weighted else [], [0.5, 1.0]), (1, True, 2, 1.5 if weighted else None, [7, 9], [0.25, 0.5] if weighted else [], [0.0, 2.0])]
        put(folder, f"words{weighted}", text.format_words_file(rows, 3, weighted))
        assert [tuple(r) for r in text.read_words_file(spark, f"{folder}/words{weighted}", weighted).orderBy("node_id").collect()] == rows
    feats = [(1.0, 2.0, 3.0, 0.5, 0.0, 0.0, 0.0, [float(i) for i in range(25)])]
    put(folder, "lowe", text.format_features(feats))
    assert [tuple(r) for r in text.read_features(spark, f"{folder}/lowe").collect()] == feats
    ox = [(1.0, 2.0, 0.0, 0.0, 0.25, 0.5, 0.75, [0.5, 1.5])]
    put(folder, "ox", text.format_features(ox, "oxford"))
    assert [tuple(r) for r in text.read_features(spark, f"{folder}/ox", "oxford").collect()] == ox


def test_matrices(spark):
    folder, cells = scratch(spark, "m"), [(0, 1, 0.5), (0, 2, 1.0), (2, 0, 3.0)]
    for name, data in text.format_sparse_matrix(cells, 3, 4).items():
        put(folder, f"c_{name}", data)
    assert sorted(tuple(r) for r in text.sparse_matrix(spark, f"{folder}/c").collect()) == cells
    put(folder, "dense", "2 3\n1 2 3\n4 5 6\n")
    assert [r.vec for r in text.dense_matrix(spark, f"{folder}/dense").orderBy("doc_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert [r.vec for r in text.dense_matrix(spark, f"{folder}/dense", "columns").orderBy("doc_id").collect()] == [[1, 4], [2, 5], [3, 6]]
    put(folder, "labels", text.format_value_column([2, 0, 1]))
    assert [r.label for r in text.value_column(spark, f"{folder}/labels").orderBy("doc_id").collect()] == [2, 0, 1]
    assert text.format_clustering([1, 0], ["a", "b"]) == "2\n1\ta\n0\tb\n"


def test_matrix_in_parts(spark):
    from brindle.plans import registry

    registry.load()
    prefix, cells = f"{scratch(spark, 'parts')}", [(d, w, float(d + w)) for d in (0, 3, 4, 9) for w in range(d % 3, 40, 3)]
    text.write_sparse_matrix(spark.createDataFrame(cells[::-1], "doc_id long, word_id long, val double"), 40, prefix, count=7)
    assert spark.read.text(f"{prefix}_row_ccs").inputFiles()[1:] and sorted(tuple(r) for r in text.sparse_matrix(spark, prefix).collect()) == cells
    text.write_sparse_matrix(spark.createDataFrame([], "doc_id long, word_id long, val double"), 0, f"{prefix}-none")
    assert text.sparse_matrix(spark, f"{prefix}-none").count() == 0
    sf = "/root/testdata/sf0.001"
    whole, counts = registry.QUERIES["s13_sparse_matrix"](spark, sf), registry.QUERIES["a2_term_frequency"](spark, sf)
    assert whole.count() == counts.count() and whole.select("word_id").distinct().count() == whole.agg({"word_id": "max"}).first()[0] + 1


def scene():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:128, :128]
    image = sum(a * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s)) for cy, cx, s, a in zip(rng.uniform(15, 113, 25), rng.uniform(15, 113, 25), rng.uniform(2, 6, 25), rng.uniform(-1, 1, 25), strict=True))
    return (image - image.min()) / np.ptp(image)


def test_features_survive_rotation():
    image = scene()
    a, b = sift.features(image), sift.features(np.rot90(image).copy())
    other, hits = np.array([v for _, v in b]), 0
    for p, v in a:
        q = b[np.linalg.norm(other - v, axis=1).argmin()][0]
        hits += abs(q.x - p.y) < 1.5 and abs(q.y - (127 - p.x)) < 1.5
    assert len(a) > 15 and hits >= 0.7 * len(a)
    assert all(v.min() >= 0 and v.max() <= 255 for _, v in a) and [p.scale for p, _ in a] == sorted((p.scale for p, _ in a), reverse=True)
    assert len(sift.features(image, most=5)) == 5 and len(sift.features(image, most=5, weight=-1)) == 5
    assert sift.features(np.zeros((40, 40))) == []


def test_images_as_rows(spark):
    image = b"P5\n# made here\n128 128 255\n" + (scene() * 255).astype("u1").tobytes()
    df = spark.createDataFrame([(1, image), (2, b"P6 20 20 255\n" + bytes(1200))], "fid long, content binary")
    rows = image_features.extract(df, most=12).collect()
    assert {r.fid for r in rows} == {1} and sorted(r.sid for r in rows) == list(range(len(rows))) and len(rows[0].vec) == 128
    basis = image_features.learn_basis(df, most=30)
    pca = image_features.extract(df, most=12, kind="pca", basis=basis).collect()
    assert len(pca) == len(rows) and len(pca[0].vec) <= 36


def test_registered_features_are_not_cut(spark, monkeypatch):
    from brindle.plans import imaging, registry

    image = b"P5 128 128 255\n" + (scene() * 255).astype("u1").tobytes()
    df = spark.createDataFrame([(1, image), (2, image)], "fid long, content binary")
    monkeypatch.setattr(imaging, "drawn", lambda spark, sf_dir: df)
    registry.load()
    whole = sift.features(sift.decode_pnm(image), most=3000, double=True)
    for name in ("f1_f7_sift_features", "f8_pca_sift_features"):
        rows = [r for r in registry.QUERIES[name](spark, "").collect() if r.fid == 1]
        assert len(rows) == len(whole) > 10 and sorted(round(r.scl, 6) for r in rows) == sorted(round(p.scale, 6) for p, _ in whole)


def test_descriptors_are_clipped_once():
    """Unit length, clipped at 0.2, unit length: clipping again would lower the large values once more."""
    from brindle.functions import sift

    v = np.ones(128)
    v[:3] = 50.0
    unit = v / np.sqrt((v * v).sum())
    unit = np.minimum(unit, 0.2)
    unit /= np.sqrt((unit * unit).sum())
    assert unit.max() > 0.2 and sift.whole_numbers(v).tolist() == np.minimum(255, (512 * unit).astype(int)).tolist()
    assert not sift.whole_numbers(np.zeros(128)).any()


def test_images_are_dealt_over_tasks(spark, monkeypatch):
    """A table in one small file, whose images take long: they go to as many tasks as they need."""
    from pyspark.sql import functions as F

    from brindle.plans import imaging

    monkeypatch.setattr(imaging, "PART_IMAGES", 25)
    images = imaging.drawn(spark, "/root/testdata/sf0.001")
    sizes = [r.n for r in images.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 20 and sum(sizes) == 500 and max(sizes) <= 40
    assert images.select("fid").distinct().count() == 500


def test_cubes_by_axis():
    dog = np.random.default_rng(3).normal(size=(5, 9, 11))
    cubes = np.lib.stride_tricks.sliding_window_view(dog, (3, 3, 3))
    assert np.array_equal(sift._around(dog, np.maximum), cubes.max(axis=(3, 4, 5)))
    assert np.array_equal(sift._around(dog, np.minimum), cubes.min(axis=(3, 4, 5)))


def test_basis_sample_orders_ids_first(spark, monkeypatch):
    """Only the sample's images are ordered; before, each part left ``sample`` images to one task. Null and repeated ids count as rows."""
    from pyspark.sql import functions as F

    rows = [(None if i % 9 == 7 else i // 2, bytes([i])) for i in range(60)]
    df, held = spark.createDataFrame(rows, "fid long, content binary").repartition(20), []
    monkeypatch.setattr(image_features, "extract", lambda few, **options: held.append(few) or spark.createDataFrame([([0.0, 1.0],), ([1.0, 0.0],)], "vec array<double>"))
    for sample in (3, 12, 100):
        image_features.learn_basis(df, sample=sample)
        want = df.select("fid").orderBy(F.xxhash64("fid"), "fid").limit(sample)
        assert sorted(str(r.fid) for r in held[-1].collect()) == sorted(str(r.fid) for r in want.collect())
    assert None in {r.fid for r in held[-1].collect()}
    image_features.learn_basis(df, sample=3)
    plan = held[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and plan.index("Sort") < plan.index("Filter")


def test_tokens_pass_sizes_only_through_one_task(spark, tmp_path):
    """The window over parts has part names and sizes; before, it had the values of all parts."""
    from brindle.sources import text

    (tmp_path / "x").mkdir()
    for name, values in (("a", "5 6\n7"), ("b", ""), ("c", "8\n9\n")):
        (tmp_path / "x" / name).write_text(values)
    found = text._tokens(spark, f"file://{tmp_path}/x", "long")
    assert sorted(tuple(r) for r in found.collect()) == [(0, 5), (1, 6), (2, 7), (3, 8), (4, 9)]
    window = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line)
    below = found._jdf.queryExecution().optimizedPlan().toString().split(window)[1].splitlines()[1]
    assert "Project [" in below and "size(" in below and " AS v#" not in below and ", v#" not in below


def test_dense_matrix_in_parts(spark, tmp_path):
    """Points go in several parts, whose lines no task reads together; nulls, empty vectors and repeated ids keep their places."""
    vecs = [[float(i), i / 7] for i in range(20)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(20, None), (21, [1.0, None]), (22, []), (23, [5.0, 6.0]), (23, [5.0, 6.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows[::-1], "kp_id long, vec array<double>").repartition(3)
    text.write_dense_matrix(df, f"{tmp_path}/m", "kp_id", count=10)
    parts = [p for p in (tmp_path / "m_rows").iterdir() if p.name.startswith("part-")]
    assert len(parts) > 3 and max(p.read_text().count("\n") for p in parts) < 12
    assert [p.read_text() for p in (tmp_path / "m_dim").glob("part-*") if p.stat().st_size] == ["26 2\n"]
    assert sorted((r.doc_id, r.vec) for r in text.dense_rows(spark, f"{tmp_path}/m").collect()) == [(i, v) for i, (_, v) in enumerate(rows)]
    text.write_dense_matrix(df.limit(0), f"{tmp_path}/e", "kp_id")
    assert text.dense_rows(spark, f"{tmp_path}/e").count() == 0


def test_dense_matrix_query_reads_parts(spark, monkeypatch):
    from brindle.plans import registry

    registry.load()
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(text, "_whole", None)  # one task would read the whole file
    assert registry.QUERIES["s13_dense_matrix"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_features_take_one_call_a_step(monkeypatch):
    """All extrema of an octave are refined together and tops are those of whole cubes; an image's rows don't take a frame of their own."""
    dog = np.random.default_rng(3).normal(size=(5, 20, 24)).round(1) / 20
    middle = dog[1:-1, 1:-1, 1:-1]
    top = (middle > 0) & (middle >= sift._around(dog, np.maximum)) | (middle < 0) & (middle <= sift._around(dog, np.minimum))
    want = np.argwhere(top & (np.abs(middle) > 0.5 * sift.CONTRAST / sift.INTERVALS)) + 1
    assert len(want) > 5 and np.array_equal(sift._tops(dog), want)
    calls, own = [], np.linalg.pinv
    monkeypatch.setattr(sift.np.linalg, "pinv", lambda x: calls.append(len(x)) or own(x))
    inside = want[((want[:, 1:] >= sift.BORDER) & (want[:, 1:] < np.array(dog.shape[1:]) - sift.BORDER)).all(axis=1)]
    together = sift._refined(dog, inside)
    assert len(calls) <= sift.STEPS and calls[0] == len(inside) > 1
    for at, found in zip(inside, together, strict=True):
        alone = sift._refined(dog, at[None])[0]
        assert (found is None) == (alone is None) and (found is None or found[:3] == alone[:3] and np.array_equal(found[3], alone[3]) and found[4] == alone[4])


def test_features_of_many_images_share_frames(spark):
    image = b"P5 64 64 255\n" + (np.add.outer(np.arange(64), np.arange(64)) % 17 * 15).astype("u1").tobytes()
    df = spark.createDataFrame([(i, image) for i in range(6)], "fid long, content binary").coalesce(1)
    rows = image_features.extract(df).collect()
    alone = image_features.extract(df.where("fid = 3")).collect()
    assert [r[1:] for r in rows if r.fid == 3] == [r[1:] for r in alone] and {r.fid for r in rows} == (set(range(6)) if alone else set())
