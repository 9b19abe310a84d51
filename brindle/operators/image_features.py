"""Local features of images as a DataFrame: one pass over image bytes in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import sift

SCHEMA = "fid long, sid int, x double, y double, scl double, ori double, contr double, rpc double, vec array<double>"


#: Features that a task gives on at once.
FRAME_ROWS = 1024


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def extract(images: DataFrame, most: int = 100, weight: float = 0.5, double: bool = True, kind: str = "sift", basis: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Features of images (fid, content), content a binary PGM or PPM file; sid numbers an image's features from 0."""

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames):
        rows = []
        for f in frames:
            for fid, content in zip(f["fid"], f["content"], strict=True):
                found = sift.features(sift.decode_pnm(bytes(content)), most, weight, double, kind, basis)
                rows += [(fid, i, p.x, p.y, p.scale, p.orientation, p.contrast, p.curvature, vec.astype(float)) for i, (p, vec) in enumerate(found)]
                # A frame costs more than the features of an image.
                if len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    return images.select("fid", "content").mapInPandas(run, SCHEMA)


def learn_basis(images: DataFrame, sample: int = 200, **options) -> tuple[np.ndarray, np.ndarray]:
    """PCA basis from the patches of the first ``sample`` images by hash of their id."""
    order = (F.xxhash64("fid"), F.col("fid"))
    ids = [r["fid"] for r in images.select("fid").orderBy(*order).limit(sample).collect()]
    # Each task would leave ``sample`` images to the order: their ids come first.
    known = F.col("fid").isin([i for i in ids if i is not None]) | (F.col("fid").isNull() & F.lit(None in ids))
    few = images.where(known).orderBy(*order).limit(sample)
    rows = extract(few, kind="patch", **options).select("vec").toPandas()
    return sift.learn_basis(np.stack(rows["vec"].to_numpy()))
