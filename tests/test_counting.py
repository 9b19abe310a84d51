"""What the queries over the documents' words shuffle, and into how many parts; figures for growing tables are in the README."""

import math
import re

import pytest
from pyspark.sql import functions as F

from brindle.operators import bow
from brindle.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_need_no_counts_by_word(spark):
    assert not re.search(r"keys=\[fid#\w+, word#", plan(registry.QUERIES["s16_wide_marks"](spark, SF)))


@pytest.mark.parametrize("name", ["a2_term_frequency", "a24_sparse_norms"])
def test_frequencies_shuffle_texts_only(spark, name):
    found = plan(registry.QUERIES[name](spark, SF))
    assert "Join" not in found and len(re.findall(r"\bExchange ", found)) == 1


def test_mean_weights_are_not_joined_with_idf(spark):
    found = plan(registry.QUERIES["c13_word_clusters"](spark, SF))
    assert "regexp_extract_all" in found and not re.search(r"Join \[word#", found)


def test_inverse_frequency_counts_once(spark):
    assert "regexp_extract_all" not in plan(registry.QUERIES["a3_inverse_frequency"](spark, SF))


#: Word 1 is in all images, the others in one each.
COUNTS = [(fid, word, 1 + fid) for fid in range(3) for word in (1, 10 + fid)]


def test_rare_words_go_to_given_parts(spark, monkeypatch):
    monkeypatch.setattr(bow, "SHARE", 3)
    counts = spark.createDataFrame([*COUNTS, (None, 1, 5)], "fid long, word long, n long")
    idf = bow.inverse_frequency(counts)
    found = bow.norms(counts, idf, 7)
    assert len(re.findall(r"hashpartitioning\(word#\w+, 7\), REPARTITION_BY_NUM", plan(found))) == 2
    total = sum(n for *_, n in COUNTS) + 5
    square = math.log(total / 4) ** 2 + math.log(total / 1) ** 2
    assert {r.fid: (r.nk, round(r.factor, 9)) for r in found.collect()} == {f: (2 * (1 + f), round(math.sqrt((1 + f) ** 3 * square) / (2 * (1 + f)), 9)) for f in range(3)}


def test_weights_go_to_given_parts_and_leave_out_images_without_id(spark, monkeypatch):
    monkeypatch.setattr(bow, "SHARE", 3)
    counts = spark.createDataFrame([*COUNTS, (None, 1, 5)], "fid long, word long, n long")
    found = bow.weights(counts, 7)
    assert len(re.findall(r"hashpartitioning\(word#\w+, 7\), REPARTITION_BY_NUM", plan(found))) == 2
    total = sum(n for *_, n in COUNTS) + 5
    want = {(f, w): (n, 2 * n, round(math.log(total / (4 if w == 1 else 1)) / 2, 9)) for f, w, n in COUNTS}
    assert {(r.fid, r.word): (r.n, r.nk, round(r.tfidf, 9)) for r in found.collect()} == want


def test_information_joins_nothing_by_word(spark):
    from brindle.operators import cluster_metrics

    cells = [(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.25), (2, "c", 0.75), (3, "c", 0.0), (4, "a", 1.0)]
    priors = {1: 0.5, 2: 0.25, 3: 0.25}
    found = cluster_metrics.mutual_information(spark.createDataFrame(cells, "doc_id long, word string, val double"), spark.createDataFrame(list(priors.items()), "doc_id long, prior double"))
    assert len(re.findall(r"\w+Join ", plan(found))) == 1
    used = [(d, w, v) for d, w, v in cells if v and d in priors]
    row = {w: sum(priors[d] * v for d, x, v in used if x == w) for _, w, _ in used}
    assert found.first().bits == pytest.approx(sum(priors[d] * v * math.log2(v / row[w]) for d, w, v in used))


def test_matrix_is_shuffled_once_into_given_parts(spark):
    from brindle.operators import sparse

    cells = spark.createDataFrame([(d, w, 1.0 + w) for d in range(40) for w in range(d % 5 + 1)], "doc_id long, word_id long, val double")
    rows = sparse.matrix(cells, 5, 2, parts=9).rows
    assert rows.count() == 40
    grouped = rows.groupBy("doc_id").agg(F.count("*"))
    assert grouped.rdd.getNumPartitions() == 9 and "Exchange" not in plan(grouped)
