"""Quality by ordinal cumulative-link regression on graded ratings.

Ratings are grades 0, 1, 2 ...; P(grade <= k) is the logistic function of threshold k minus a score. The weights of the hashed
text features are shared by all grades, the thresholds are ordered. From them follow the expected grade and the tail probability
P(grade >= ``least``), by which documents are selected.

Of the labels at hand, the grades are 0 (quality 0), 1 (good but toxic) and 2 (good).

Defined results: a null text counts as empty and is scored like any text. A null doc_id passes through. Without labels
every document is kept. Repeated rows get equal results, an empty table an empty one. A very long text is scored whole. Kept columns
that clash with an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import release, slices, with_fields
from brindle.llm.linear import CHOSEN, Extractor, Model, fit, labelled

GRADES, LEAST, THRESHOLD = 3, 1, 0.4


def grades(labels: np.ndarray) -> np.ndarray:
    """Grades from columns quality and toxic."""
    return np.where(labels[:, 0] == 0, 0, np.where(labels[:, 1] != 0, 1, 2))


def fit_grades(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int | None = CHOSEN) -> Model | None:
    """The model from a bounded sample of labelled rows; None if there are none. ``most`` as in ``linear.fit``."""
    sample = labelled(df, labels, ["quality", "toxic"], text_col, id_col)
    return fit(sample, grades(sample.labels), GRADES, most=most) if len(sample) else None


def quality(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, least: int = LEAST, threshold: float = THRESHOLD, most: int | None = CHOSEN) -> DataFrame:
    """``keep`` (all columns unless given) with expected_grade, p_tail and selected (p_tail is at least the threshold)."""
    keep = df.columns if keep is None else keep
    model = fit_grades(df, labels, text_col, id_col, most)
    new = [T.StructField("expected_grade", T.DoubleType(), False), T.StructField("p_tail", T.DoubleType(), False), T.StructField("selected", T.BooleanType(), False)]
    schema, through = with_fields(df, keep, new)

    def run(batches):
        own = Extractor(set(model.weights) if model else set())
        for batch in batches:
            for part in slices(batch, "__text"):
                got = [model.tails(model.score(*own.features(t))) if model else [1.0] * (GRADES - 1) for t in part.column("__text").to_pylist()]
                expected, tail = [sum(t) for t in got], [t[least - 1] for t in got]
                columns = [pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= threshold for t in tail], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)
        own.known.clear()
        release()

    return df.select(*through, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def select(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that the model selects, with its columns."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    own = df.withColumnsRenamed(names).withColumn(id_col, F.col(names[id_col]))
    kept = quality(own, labels, names[text_col], id_col, keep=list(names.values()), **options)
    return kept.where("selected").select(*[F.col(n).alias(c) for c, n in names.items()])
