import hashlib
import zlib

import pytest

from brindle.llm import media
from brindle.llm.common import scratch

TEXTS = [None, "", "a", "x" * 63, "x" * 64, "é" * 500, "same", "same", "long " * 40_000]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i if i != 2 else None, t, "m") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string").repartition(3)


def test_round_trip(docs):
    rows = media.digests(media.store_and_read(docs, range_bytes=1000, batch_bytes=500)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[2 if r.doc_id is None else r.doc_id]
        data, n = media.payload(text)
        assert data.rstrip(b"\0") == (text or "").encode().rstrip(b"\0") and len(data) % 64 == 0 and data
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(data), hashlib.sha256(data).hexdigest())
        assert r.tail_crc32 == zlib.crc32(data[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(media.to_png(data)), hashlib.sha256(media.to_png(data)).hexdigest())
        assert r.feature == media.features(data)
    assert media.digests(media.store_and_read(docs.limit(0))).count() == 0


def test_image():
    data = bytes(range(256)) * 3
    image = media.to_png(data)
    assert image[12:16] == b"IHDR" and image[-8:-4] == b"IEND" and media.from_png(image) == data
    for bad in (b"\0" * 60, image[:-12], image[:40] + b"x" + image[41:]):
        with pytest.raises((ValueError, zlib.error)):
            media.from_png(bad)


def test_ranges_read_each_member_once(docs, spark):
    folder = scratch(spark, "media")
    assert media.write_media(docs, folder) == len(TEXTS)
    for size in (1, 77, 5000, 10**9):
        reader = media.MediaReader({"path": folder, "range_bytes": size})
        names = [n for p in reader.partitions() for b in reader.read(p) for n in b.column(0).to_pylist()]
        assert len(names) == len(set(names)) == len(TEXTS)


def test_partitions_without_rows(docs, spark, tmp_path):
    few = docs.where("doc_id IN (5, 6)").coalesce(1).repartitionByRange(8, "doc_id")
    assert sorted(r.doc_id for r in media.digests(media.store_and_read(few)).collect()) == [5, 6]
    docs.where("doc_id > 99").write.parquet(f"{tmp_path}/none")
    assert media.digests(media.store_and_read(spark.read.parquet(f"{tmp_path}/none"))).count() == 0
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")  # one row group, most tasks of the scan have no rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        read = spark.read.parquet(f"{tmp_path}/one")
        assert read.rdd.getNumPartitions() > 4
        assert media.digests(media.store_and_read(read)).count() == len(TEXTS)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archives_are_rolled_over(docs, spark):
    folder = scratch(spark, "media")
    assert media.write_media(docs.coalesce(1), folder, archive_bytes=100) == len(TEXTS)
    reader = media.MediaReader({"path": folder})
    assert 4 <= len(reader.partitions()) < len(TEXTS)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(TEXTS)


def test_directory_is_read_again(docs, spark):
    folder = scratch(spark, "media")
    media.write_media(docs, folder)
    reader, calls = media.MediaReader({"path": folder, "retries": 2}), []
    true = reader.directory

    def flaky(store, path):
        calls.append(path)
        if calls.count(path) < 3:
            raise OSError("lost")
        return true(store, path)

    reader.directory = flaky
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(TEXTS) and len(calls) == 9
    reader.retries = 1
    calls.clear()
    with pytest.raises(OSError, match="lost"):
        list(reader.read(reader.partitions()[0]))


def test_members_are_retried_by_themselves(docs, spark):
    folder = scratch(spark, "media")
    media.write_media(docs, folder)
    reader = media.MediaReader({"path": folder, "retries": 2})
    true, calls = reader.fetch, {}

    def flaky(store, path, info):
        calls[info.filename] = calls.get(info.filename, 0) + 1
        if ".5." in info.filename and calls[info.filename] < 3 or ".7." in info.filename:
            raise OSError("lost")
        return true(store, path, info)

    reader.fetch = flaky
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["error"] for r in rows if r["doc_id"] == 7] == ["lost"] and all(r["media"] for r in rows if r["doc_id"] != 7)
    assert {calls[n] for n in calls if ".5." in n or ".7." in n} == {3} and {calls[n] for n in calls if ".5." not in n and ".7." not in n} == {1}


def test_damage_is_found(docs, spark):
    folder = scratch(spark, "media")
    media.write_media(docs.where("doc_id = 5").coalesce(1), folder)
    reader = media.MediaReader({"path": folder, "retries": 1})
    path = next(p.path for p in reader.partitions() if p.end - p.start > 180)
    data = bytearray(open(path, "rb").read())
    data[120] ^= 1
    open(path, "wb").write(data)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["media"], r["error"]) for r in rows] == [(None, "length or CRC differs")]
