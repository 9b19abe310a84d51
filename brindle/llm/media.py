"""Media columns: payloads stored losslessly as 8-bit samples in archives, read back by a Spark data source.

``write_media`` has every task write its payloads as PNG members (8-bit grey, 64 samples a row, deflated) of
zip archives that store them as they are, in a folder that all executors share. An archive of ``ARCHIVE_BYTES`` is closed and
the next one begun, so that no central directory grows with the task. A task writes under names of its own and
renames them at the end, so a task that is repeated replaces its archives whole; a task without rows leaves none.

The data source ``media`` plans partitions of byte ranges over the archives from their lengths alone. A task reads the
archive's central directory and takes the members whose header starts within its range, so each member is
read once, wherever the ranges fall. It yields Arrow batches of bounded bytes. A member is fetched by its own offset and
checked by length and CRC; if that fails it is fetched again, by itself, up to ``retries`` times. A member that stays
unreadable is a row with null media and the reason in ``error``; the others go on. Reading the directory is repeated
likewise; if it stays unreadable the task fails, as its members aren't known. Archives without members have no rows.

Paths go through pyarrow's filesystems (file, s3, gs, hdfs), by URI.

Defined results: a null text counts as empty; the payload of an empty text is 64 zero bytes. doc_id may be null.
Repeated rows are members of their own. An empty table, or partition, gives no archive and no rows. A very long text is one member, held
whole by the task that writes or reads it. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.llm.common import scratch, slices

BLOCK, LEVEL, SIGNATURE = 64, 1, b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES = 256 << 20
#: The shortest zip archive, one without members.
NO_MEMBERS = 22
MEMBERS = "member string, doc_id long, n_bytes long, media binary, error string"


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zeros appended up to a positive multiple of 64, and the length without them."""
    data = (text or "").encode()
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0"), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """Grey image of 8-bit samples, 64 a row, no row filters; the length must be a multiple of 64."""
    rows = np.frombuffer(data, "u1").reshape(-1, BLOCK)
    raw = np.zeros((len(rows), BLOCK + 1), "u1")
    raw[:, 1:] = rows
    header = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of such an image; chunk lengths and CRCs are checked."""
    at, chunks = len(SIGNATURE), []
    while at + 12 <= len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's CRC differs")
        chunks.append((kind, data))
        at += 12 + n
    if media[:8] != SIGNATURE or [k for k, _ in chunks] != [b"IHDR", b"IDAT", b"IEND"]:
        raise ValueError("not an image of this kind")
    width, height, *kind = struct.unpack(">IIBBBBB", chunks[0][1])
    raw = np.frombuffer(zlib.decompress(chunks[1][1]), "u1").reshape(height, width + 1)
    if (width, kind) != (BLOCK, [8, 0, 0, 0, 0]) or raw[:, 0].any():
        raise ValueError("not 8-bit grey without filters")
    return raw[:, 1:].tobytes()


def features(data: bytes) -> str:
    """Mean, standard deviation, share of sign changes about the middle and most frequent sample."""
    x = np.frombuffer(data, "u1")
    counts = np.bincount(x, minlength=256)
    level = np.arange(256, dtype="int64")
    n, total, square = len(x), int(counts @ level), int(counts @ (level * level))
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"mean={total / n:.4f};std={max(0.0, square / n - (total / n) ** 2) ** 0.5:.4f};crossings={crossings / n:.6f};mode={int(counts.argmax())}"


def write_media(df: DataFrame, folder: str, text_col: str = "text", id_col: str = "doc_id", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes the archives of each task into ``folder`` (a URI); returns the number of members."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        members = (x for batch in batches for part in slices(batch, "__text") for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        n, written, ahead = 0, [], next(members, None)
        while ahead:
            own, size = f"{root}/_{task.partitionId():06d}-{len(written):04d}-{task.taskAttemptId()}", 0
            with store.open_output_stream(own) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                while ahead and size < archive_bytes:
                    data, length = payload(ahead[1])
                    image = to_png(data)
                    archive.writestr(zipfile.ZipInfo(f"{n:09d}.{'' if ahead[0] is None else ahead[0]}.{length}.png"), image)
                    n, size, ahead = n + 1, size + len(image), next(members, None)
            written.append((own, f"{root}/part-{task.partitionId():06d}-{len(written):04d}.zip"))
        for own, final in written:
            store.move(own, final)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.select(F.col(id_col).cast("long"), F.col(text_col).alias("__text")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 64 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if os.path.basename(f.path).startswith("part-") and f.size > NO_MEMBERS)
        return [ByteRange(p, a, min(size, a + self.range_bytes)) for p, size in files for a in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def fetch(self, store, path: str, info: zipfile.ZipInfo) -> bytes:
        """The stored bytes of one member, by its offset, checked."""
        with store.open_input_file(path) as f:
            f.seek(info.header_offset)
            header = f.read(30)
            if header[:4] != b"PK\x03\x04" or info.compress_type != zipfile.ZIP_STORED:
                raise OSError("no stored member at this offset")
            name, extra = struct.unpack_from("<HH", header, 26)
            f.seek(info.header_offset + 30 + name + extra)
            data = f.read(info.file_size)
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise OSError("length or CRC differs")
        return data

    def again(self, f, *args):
        """``f``'s result, tried anew up to ``retries`` times; then its error is raised."""
        for k in range(self.retries + 1):
            try:
                return f(*args)
            except (OSError, ValueError, zipfile.BadZipFile):
                if k == self.retries:
                    raise
                time.sleep(0.05 * k)

    def member(self, store, path: str, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        try:
            return self.again(self.fetch, store, path, info), None
        except (OSError, ValueError) as e:
            return None, str(e)

    def directory(self, store, path: str) -> list[zipfile.ZipInfo]:
        with store.open_input_file(path) as f:
            return zipfile.ZipFile(io.BufferedReader(f)).infolist()

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        rows, held = [], 0
        for info in self.again(self.directory, store, partition.path):
            if partition.start <= info.header_offset < partition.end:
                media, error = self.member(store, partition.path, info)
                _, key, length, _ = info.filename.split(".")
                rows.append((f"{os.path.basename(partition.path)}/{info.filename}", int(key) if key else None, int(length), media, error))
                held += info.file_size
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        names = ("member", "doc_id", "n_bytes", "media", "error")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaSource(DataSource):
    """``spark.read.format("media").option("range_bytes", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: T.StructType) -> MediaReader:
        return MediaReader(self.options)


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media").options(**options).load(folder)


def store_and_read(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", folder: str | None = None, **options) -> DataFrame:
    """The members of a new archive folder below the shared one; drop the folder when its rows are no longer needed."""
    spark = df.sparkSession
    folder = folder or scratch(spark, "media")
    write_media(df, folder, text_col, id_col)
    return read_media(spark, folder, **options)


def digests(members: DataFrame) -> DataFrame:
    """Lengths, digests and features of the payloads read back. An unreadable member raises here."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for key, length, media, error in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if media is None:
                        raise OSError(f"doc_id {key}: {error}")
                    data = from_png(media)
                    rows.append((key, length, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(data)))
                i, s = pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (i, i, i, s, i, i, s, s), strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return members.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, schema)
