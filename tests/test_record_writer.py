"""The writer of binary records: commit, overwrite, append, failure."""

import os

import pytest
from pyspark.sql import functions as F

from brindle.sources import records


def rows(spark, n, first=0, parts=3):
    return spark.range(first, first + n, numPartitions=parts).select(F.col("id").alias("kp_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))


def save(df, folder, mode):
    df.sparkSession.dataSource.register(records.RecordSource)
    df.write.format("records").option("layout", "vectors").mode(mode).save(folder)


def values(spark, folder):
    return [int(r.vec[0]) for r in records.read(spark, folder).orderBy("kp_id").collect()]


def test_append_and_overwrite(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    save(rows(spark, 10), folder, "overwrite")
    assert values(spark, folder) == list(range(10))
    save(rows(spark, 5, 10, 2), folder, "append")
    assert values(spark, folder) == list(range(15))
    assert sorted(os.listdir(tmp_path / "v")) == [f"part-{i:06d}" for i in range(5)]
    save(rows(spark, 4, 50, 1), folder, "overwrite")
    assert values(spark, folder) == list(range(50, 54)) and len(os.listdir(tmp_path / "v")) == 1
    save(rows(spark, 0), folder, "overwrite")
    assert values(spark, folder) == [] and os.listdir(tmp_path / "v") == []


def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    save(rows(spark, 6), folder, "overwrite")
    ragged = rows(spark, 30).withColumn("vec", F.when(F.col("kp_id") == 29, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vec")))
    null = rows(spark, 30).withColumn("vec", F.when(F.col("kp_id") != 29, F.col("vec")))
    stops = rows(spark, 30).withColumn("vec", F.when(F.col("kp_id") == 29, F.raise_error(F.lit("stop"))).otherwise(F.col("vec")))
    unequal = rows(spark, 4, parts=1).unionByName(rows(spark, 4, parts=1).withColumn("vec", F.slice("vec", 1, 1)))
    for df in (ragged, null, stops, unequal):
        for mode in ("append", "overwrite"):
            with pytest.raises(Exception):
                save(df, folder, mode)
            assert values(spark, folder) == list(range(6))
            assert all(name.startswith("part-") for name in os.listdir(tmp_path / "v"))


def test_attempts_that_do_not_count(spark, tmp_path):
    """Files of an attempt without a message, and equal places of two jobs."""
    writer = records.RecordWriter({"path": f"file://{tmp_path}/v"}, overwrite=False)
    staged = tmp_path / "v" / writer.folder
    staged.mkdir(parents=True)
    (staged / "000000-7").write_bytes(b"lost")
    writer.commit([None])
    assert os.listdir(tmp_path / "v") == []
