import hashlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as cp
from brindle.llm import mixing, quality, toxicity
from tests.llm.test_wide_simhash import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows each stage leaves."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in cp.STAGES:
        f(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_columns(stages):
    assert 4 <= len(cp.STAGES) <= 5
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_filters(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in stages[:-1]]
    good = {r.doc_id for r in quality.quality(stages[0], labels).where("selected").collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if i in good) and 0 < len(ids[1]) < len(ids[0])
    toxic = {r.doc_id for r in toxicity.toxicity(stages[1], labels, source=stages[0]).where("is_toxic").collect()}
    assert sorted(ids[2]) == sorted(i for i in ids[1] if i not in toxic) and toxic
    # The stage's rule is five words and a similarity of 0.8, not the three bits of op5's contract.
    assert sorted(ids[3]) == sorted(set(brute([(r.doc_id, r.text or "") for r in stages[2].collect()])))


def test_mix_and_encoding(stages):
    con = duckdb.connect()
    documents = stages[3].select("doc_id", "source", "text").toPandas()  # noqa: F841
    want = {d: t // s if s else None for d, s, _, _, t in con.execute(mixing.SQL).fetchall()}
    got = {}
    for r in stages[4].select("doc_id").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert all(got.get(d, 0) == k for d, k in want.items() if k is not None)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, ties, repeated rows, a long text and an extra column through every stage, and an empty table."""
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None, "en", "web", 0), (2, "", None, "web", None), (None, "some words of no id at all", "en", None, 5), (3, long, "en", "web", 9), (3, long, "en", "web", 9), (4, long + " more", "de", "web", 9), (None, "some words of no id at all", "en", None, 5), (6, "one", "en", "news", 3)]
    docs = spark.createDataFrame([(*r, f"x{i}") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, p_toxic string")
    docs.limit(0).drop("p_toxic").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for table, counts in ((docs, [8, 8, 4]), (docs.limit(0), [0, 0, 0])):
        now = table
        for (_, f), n in zip(cp.STAGES[:3], counts, strict=True):
            now = f(spark, now, str(tmp_path))
            assert now.columns == docs.columns and now.count() == n
        mixed = cp.mix_sources(spark, now, str(tmp_path))
        assert mixed.columns == docs.columns
        coded = cp.encode(spark, mixed, str(tmp_path))
        assert coded.count() == mixed.count()
    assert cp.run(spark, str(tmp_path)).count() == 0
