"""Queries for local features, over images drawn from the embeddings (the outer product of a vector's halves)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brindle.operators import image_features
from brindle.plans.registry import query
from brindle.plans.tables import read

#: The defaults of the reference's programs: keypoints of an image, and whether it is doubled first.
DEFAULTS = {"most": 3000, "double": True}

#: Images of a task: their features take much longer than the few bytes of their rows tell.
PART_IMAGES = 128


def drawn(spark, sf_dir):
    def run(frames):
        for f in frames:
            out = []
            for v in f["embedding"]:
                v = np.asarray(v, float)
                image = np.outer(v[:32], v[32:])
                image = np.repeat(np.repeat((image - image.min()) / (np.ptp(image) or 1), 2, 0), 2, 1)
                out.append(b"P5 64 64 255\n" + (image * 255).astype("u1").tobytes())
            yield pd.DataFrame({"fid": f["vec_id"], "content": out})

    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PART_IMAGES))
    return rows.repartition(parts).mapInPandas(run, "fid long, content binary")


@query("f1_f7_sift_features")
def features(spark, sf_dir):
    return image_features.extract(drawn(spark, sf_dir), **DEFAULTS).withColumn("vec", F.array_join(F.col("vec").cast("array<int>").cast("array<string>"), " "))


@query("f8_pca_sift_features")
def pca_features(spark, sf_dir):
    images = drawn(spark, sf_dir)
    basis = image_features.learn_basis(images, 50, **DEFAULTS)
    found = image_features.extract(images, **DEFAULTS, kind="pca", basis=basis)
    return found.select("fid", "sid", F.round("scl", 6).alias("scl"), F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))
