"""Binary files of fixed-length records behind a header: descriptor matrices and raw feature files.

One Spark data source, ``records``, plans partitions of row ranges over a file or a folder of ``part-`` files; tasks seek to
their rows and yield Arrow batches, and writes parts that appear when the job commits. Row numbers run over all files in the order of their names, so ids don't depend on the
partitioning. Paths go through pyarrow's filesystems, by URI.

Layouts: ``vectors`` (uint32 element size, rows, columns; rows of float32 or uint16), ``features`` (int64 count, int32 limit;
int64 fid, int32 sid, six float32, 128 float32) and ``pca_features`` (the same with four and 36 float64).
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

HEADER = 12
ELEMENTS = {4: "<f4", 2: "<u2"}
FEATURES = np.dtype([("fid", "<i8"), ("sid", "<i4"), ("info", "<f4", 6), ("vec", "<f4", 128)])
PCA_FEATURES = np.dtype([("fid", "<i8"), ("sid", "<i4"), ("info", "<f8", 4), ("vec", "<f8", 36)])
NAMES = {"features": ("x", "y", "scl", "ori", "contr", "rpc"), "pca_features": ("x", "y", "scl", "ori")}
SCHEMAS = {
    "vectors": "kp_id long, vec array<float>",
    "features": "kp_id long, fid long, sid int, x double, y double, scl double, ori double, contr double, rpc double, vec array<float>",
    "pca_features": "kp_id long, fid long, sid int, x double, y double, scl double, ori double, vec array<float>",
}


def _layout(layout: str, header: bytes) -> tuple[np.dtype, int]:
    """Record type and number of records."""
    if layout == "vectors":
        size, rows, columns = struct.unpack("<3I", header)
        return np.dtype([("vec", ELEMENTS[size], (columns,))]), rows
    count, _ = struct.unpack("<qi", header)
    return (FEATURES if layout == "features" else PCA_FEATURES), count


class Rows(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.layout = options["path"], options.get("layout", "vectors")
        self.rows, self.batch = int(options.get("rows", 1 << 20)), int(options.get("batch", 8192))

    def partitions(self) -> list[Rows]:
        store, root = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(root)
        files = [root] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if os.path.basename(f.path).startswith("part-"))
        out, first = [], 0
        for path in files:
            with store.open_input_file(path) as f:
                _, n = _layout(self.layout, f.read(HEADER))
            out += [Rows(path, first, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
            first += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(partition.path) as f:
            kind, _ = _layout(self.layout, f.read(HEADER))
            f.seek(HEADER + partition.start * kind.itemsize)
            for a in range(partition.start, partition.end, self.batch):
                n = min(self.batch, partition.end - a)
                data = f.read(n * kind.itemsize)
                if len(data) != n * kind.itemsize:
                    raise OSError(f"{partition.path} ends before row {a + n}")
                yield self.arrow(np.frombuffer(data, kind), partition.first + a)

    def arrow(self, rows: np.ndarray, first: int) -> pa.RecordBatch:
        width = rows["vec"].shape[1]
        flat = pa.array(np.ascontiguousarray(rows["vec"]).reshape(-1).astype("f4"))
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype="i4") * width), flat)
        columns = {"kp_id": pa.array(np.arange(first, first + len(rows)))}
        if self.layout != "vectors":
            columns |= {"fid": pa.array(rows["fid"].astype("i8")), "sid": pa.array(rows["sid"].astype("i4"))}
            columns |= {name: pa.array(rows["info"][:, i].astype("f8")) for i, name in enumerate(NAMES[self.layout])}
        return pa.RecordBatch.from_pydict(columns | {"vec": vec})


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    order: int
    rows: int
    width: int


class RecordWriter(DataSourceArrowWriter):
    """Tasks stage their parts with whole headers in a folder of the job; the commit moves them behind the parts there are, and ``overwrite`` then removes those.

    Parts follow the partitions' order. Rows of unequal widths, in one part or between parts, are an error, as are null vectors. A failed job, and attempts that
    don't count, leave nothing behind.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.layout, self.overwrite = options["path"], options.get("layout", "vectors"), overwrite
        self.element, self.limit = options.get("element", "<f4"), int(options.get("limit", 0))
        self.folder = f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(f"{root}/{self.folder}", recursive=True)
        own, n, kind = f"{root}/{self.folder}/{task.partitionId():06d}-{task.taskAttemptId()}", 0, None
        with store.open_output_stream(f"{own}.body") as out:
            for batch in iterator:
                if batch.num_rows:
                    rows = self.records(batch)
                    if kind is not None and rows.dtype != kind:
                        raise ValueError("rows of unequal widths")
                    out.write(rows.tobytes())
                    n, kind = n + len(rows), rows.dtype
        if not n:
            return Written(None, task.partitionId(), 0, 0)
        width = kind["vec"].shape[0]
        with store.open_output_stream(own) as out, store.open_input_stream(f"{own}.body") as data:
            out.write(struct.pack("<3I", kind["vec"].base.itemsize, n, width) if self.layout == "vectors" else struct.pack("<qi", n, self.limit))
            while block := data.read(1 << 20):
                out.write(block)
        return Written(own, task.partitionId(), n, width)

    def records(self, batch: pa.RecordBatch) -> np.ndarray:
        vec = batch.column(batch.schema.get_field_index("vec"))
        sizes = np.unique(vec.value_lengths().to_numpy(zero_copy_only=False))
        if vec.null_count or len(sizes) != 1:
            raise ValueError("null vectors or rows of unequal widths")
        flat = vec.flatten()
        if flat.null_count:
            raise ValueError("null entries")
        width = int(sizes[0])
        kind = np.dtype([("vec", self.element, (width,))]) if self.layout == "vectors" else FEATURES if self.layout == "features" else PCA_FEATURES
        rows = np.zeros(batch.num_rows, kind)
        rows["vec"] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
        if self.layout != "vectors":
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            rows["fid"], rows["sid"] = column("fid"), column("sid")
            rows["info"] = np.stack([column(name) for name in NAMES[self.layout]], axis=1)
        return rows

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.uri)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.order)
        if len({m.width for m in parts}) > 1:
            raise ValueError("parts of unequal widths")
        store.create_dir(root, recursive=True)
        old = sorted(os.path.basename(f.path) for f in store.get_file_info(fs.FileSelector(root)) if os.path.basename(f.path).startswith("part-"))
        start = int(old[-1].removeprefix("part-")) + 1 if old else 0
        for i, m in enumerate(parts, start):
            store.move(m.path, f"{root}/part-{i:06d}")
        for name in old if self.overwrite else ():
            store.delete_file(f"{root}/{name}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, root = fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(f"{root}/{self.folder}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.folder}")


class RecordSource(DataSource):
    """``spark.read.format("records").option("layout", "vectors").load(uri)`` and ``df.write.format("records").mode("append" or "overwrite").save(uri)``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("layout", "vectors")]

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


def read(spark: SparkSession, uri: str, layout: str = "vectors", **options) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").options(layout=layout, **options).load(uri)


def write(df: DataFrame, uri: str, layout: str = "vectors", element: str = "<f4", limit: int = 0) -> int:
    """Replaces the folder's parts by ``df`` in the order of kp_id; returns the number of records."""
    df.sparkSession.dataSource.register(RecordSource)
    names = ["vec"] if layout == "vectors" else ["fid", "sid", *NAMES[layout], "vec"]
    ordered = df.select("kp_id", *names).repartitionByRange("kp_id").sortWithinPartitions("kp_id")
    ordered.write.format("records").options(layout=layout, element=element, limit=limit).mode("overwrite").save(uri)
    return sum(p.end - p.start for p in RecordReader({"path": uri, "layout": layout}).partitions())


def merge(uri: str, target: str, layout: str = "vectors") -> int:
    """One file from a folder's parts, copied in blocks behind a header with the total count."""
    store, root = fs.FileSystem.from_uri(uri)
    parts = RecordReader({"path": uri, "layout": layout, "rows": str(1 << 62)}).partitions()
    total = sum(p.end for p in parts)
    out_store, out_path = fs.FileSystem.from_uri(target)
    with out_store.open_output_stream(out_path) as out:
        for i, p in enumerate(p for p in parts if p.path):
            with store.open_input_stream(p.path) as data:
                header = data.read(HEADER)
                if i == 0:
                    size, _, columns = struct.unpack("<3I", header)
                    out.write(struct.pack("<3I", size, total, columns) if layout == "vectors" else struct.pack("<qi", total, struct.unpack("<qi", header)[1]))
                while block := data.read(1 << 20):
                    out.write(block)
    return total
