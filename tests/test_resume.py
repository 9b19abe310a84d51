"""A vocabulary continued from a written level."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import vocabulary
from brindle.plans import registry
from brindle.sources import text


def test_resumed_equals_one_go(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(7 * i % 1000, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 3)))], "kp_id long, vec array<double>")
    options = {"k": 3, "least": 10, "rounds": 3, "epsilon": 0.01}
    whole = vocabulary.hierarchy(df, levels=2, **options)
    first = whole.where("level = 1")
    text.write_level(first, f"{tmp_path}/level", count=20)
    level = text.read_level(spark, f"{tmp_path}/level")
    clusters = [r.cid for r in first.orderBy("kp_id").collect()]
    sizes = [(c, clusters.count(c)) for c in sorted(set(clusters))]
    # The sections one after another are a level file.
    (tmp_path / "one").write_text(text.format_level_file([(0, len(sizes))], sizes, clusters))
    assert sorted(map(tuple, level.collect())) == sorted(map(tuple, text.read_level_file(spark, f"{tmp_path}/one").collect()))
    again = vocabulary.hierarchy(df, levels=2, start=vocabulary.resumed(level, df), done=1, **options)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.where("level = 2").collect()))
    for wrong in (df.limit(50), df.unionByName(df.limit(1).withColumn("kp_id", F.lit(5000).cast("long")))):
        with pytest.raises(ValueError, match="level file"):
            vocabulary.resumed(level, wrong)


def test_registered(spark):
    registry.load()
    sf = "/root/testdata/sf0.001"
    whole = registry.QUERIES["c2_hierarchical_vocabulary"](spark, sf).where("level = 2")
    assert sorted(map(tuple, registry.QUERIES["c2_resumed_vocabulary"](spark, sf).collect())) == sorted(map(tuple, whole.collect()))
