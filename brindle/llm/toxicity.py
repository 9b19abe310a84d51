"""Toxicity by a classifier chain.

Categories are predicted one after another. Each has a linear model of hashed text features and of the
log-odds of the categories before it. In training, these log-odds are out-of-fold: each labelled row's come from
models that were fitted without its fold, the same folds along the whole chain. In use, they come from models fitted on all
sampled rows.

Of the labels at hand, the chain's categories are junk (low quality), toxic, and toxic_prose (toxic but not junk). A document is
toxic if the probability of either of the last two reaches the threshold.

The models are fitted on the labelled rows of ``source``, by default the table itself. A filter upstream may have removed most rows of a
category; then ``source`` should be the table before that filter.

Defined results: a null text counts as empty and is scored like any text. A null doc_id passes through. Without
labels every probability is one half at most and nothing is toxic. Repeated rows get equal results, an empty table an empty one. A
very long text is scored whole. Kept columns that clash with an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import release, slices, with_fields
from brindle.llm.linear import CHOSEN, Extractor, Model, Sample, fit, labelled, scores

LABELS = ["quality", "toxic"]
THRESHOLD, FOLDS = 0.25, 5
CHAIN = ("junk", "toxic", "toxic_prose")


def categories(labels: np.ndarray) -> list[np.ndarray]:
    """The chain's categories from columns quality and toxic."""
    junk, toxic = labels[:, 0] == 0, labels[:, 1] != 0
    return [junk, toxic, toxic & ~junk]


def fit_chain(sample: Sample, targets: list[np.ndarray], folds: int = FOLDS, most: int | None = CHOSEN) -> list[Model]:
    """One model for each category, in order; ``most`` as in ``linear.fit``."""
    models, before = [], np.zeros((len(sample), 0))
    for k, y in enumerate(targets):
        models.append(fit(sample, y.astype(int), 2, extra=before, most=most))
        if k + 1 < len(targets):
            own = np.zeros(len(sample))
            for f in range(folds):
                held = sample.fold == f
                if held.any():
                    part = fit(sample, y.astype(int), 2, rows=~held, extra=before, most=most)
                    own[held] = (scores(sample, part, before) - part.thresholds[0])[held]
            before = np.column_stack([before, np.clip(own, -8, 8)])
    return models


def predict(models: list[Model], present: set[int], shares: dict[int, float]) -> list[float]:
    odds, out = [], []
    for m in models:
        s = m.score(present, shares, odds)
        odds.append(float(np.clip(s - m.thresholds[0], -8, 8)))
        out.append(m.tails(s)[0])
    return out


def toxicity(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, threshold: float = THRESHOLD, source: DataFrame | None = None, most: int | None = CHOSEN) -> DataFrame:
    """``keep`` (all columns unless given) with a probability p_<category> for each category, and is_toxic.

    The chain is fitted on the labelled rows of ``source`` (columns id_col and text_col; ``df`` unless given).
    """
    keep = df.columns if keep is None else keep
    sample = labelled(df if source is None else source, labels, LABELS, text_col, id_col, folds=FOLDS)
    models = fit_chain(sample, categories(sample.labels), most=most)
    empty = not len(sample)
    new = [T.StructField(f"p_{c}", T.DoubleType(), False) for c in CHAIN] + [T.StructField("is_toxic", T.BooleanType(), False)]
    schema, through = with_fields(df, keep, new)

    def run(batches):
        own = Extractor(set().union(*(m.weights for m in models)))
        for batch in batches:
            for part in slices(batch, "__text"):
                got = [predict(models, *own.features(t)) for t in part.column("__text").to_pylist()]
                columns = [pa.array(c, pa.float64()) for c in zip(*got, strict=True)]
                toxic = pa.array([not empty and max(p[1:]) >= threshold for p in got], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns, toxic], names=schema.names)
        own.known.clear()
        release()

    return df.select(*through, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def clean(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", source: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``df`` that aren't toxic, with its columns."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    own = df.withColumnsRenamed(names).withColumn(id_col, F.col(names[id_col]))
    source = (df if source is None else source).select(F.col(id_col), F.col(text_col).alias(names[text_col]))
    kept = toxicity(own, labels, names[text_col], id_col, keep=list(names.values()), source=source, **options)
    return kept.where("NOT is_toxic").select(*[F.col(n).alias(c) for c, n in names.items()])
