"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.operators import vecindex, vector
from corvine.operators.best import Best


def clusters(n, dims, groups, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims)) * 4
    return middle[rng.integers(0, groups, n)] + rng.normal(size=(n, dims))


@pytest.fixture(scope="module")
def vectors(spark):
    x = clusters(3000, 32, 40, 1)
    rows = [("tu"[i % 3 == 0], i, v.tolist()) for i, v in enumerate(x)] + [("t", 5000, None), ("t", 5001, [0.0] * 32)]
    return spark.createDataFrame(rows, "tenant_id string, doc_id long, embedding array<double>")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([("tu"[i % 2], i, v.tolist()) for i, v in enumerate(clusters(60, 32, 40, 1) + 0.1)], "tenant_id string, query_id long, embedding array<double>")


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vecindex.Index.build(vectors, str(tmp_path_factory.mktemp("v") / "i"), slices=8)


def rows(df):
    return sorted((r.tenant_id, r.query_id, r.vector_rank, r.doc_id, r.similarity) for r in df.collect())


def test_recall_and_switch(vectors, questions, index):
    exact = vector.top_k(vectors.filter("embedding is not null"), questions).cache()
    got = index.search(questions)
    found = vecindex.recall(got, exact).agg(F.sum("n_found"), F.sum("n_exact")).first()
    assert found[0] >= 0.95 * found[1]
    assert index.probes < len(index.codes.centre) // 2  # clustered vectors need few lists
    assert rows(index.search(questions, exact=True)) == rows(exact)
    assert rows(index.search(questions, probes=10**6, pool=10**6)) == rows(exact)
    # what is found has its exact similarity, in its own organisation
    known = {(r.tenant_id, r.query_id, r.doc_id): r.similarity for r in vector.top_k(vectors.filter("embedding is not null"), questions, 5000).collect()}
    assert all(known[r.tenant_id, r.query_id, r.doc_id] == r.similarity for r in got.collect())


def test_blocks_of_questions(questions, index, monkeypatch):
    want = rows(index.search(questions, 5))
    monkeypatch.setattr(vecindex, "BLOCK", 7)
    assert rows(index.search(questions, 5)) == want


def test_crowded_lists_are_cut(spark, vectors, questions, tmp_path, monkeypatch):
    monkeypatch.setattr(vecindex, "LIST", 100)
    one = vecindex.Index.build(vectors, str(tmp_path / "one"), lists=1, slices=8)
    pieces = one.lists().groupBy("tenant_id", "piece").count().collect()
    assert len(pieces) == 31 and max(r["count"] for r in pieces) < 160 and one.probes == 1
    assert one.lists().filter("embedding is null").count() == 0


def test_codes_estimate_products(index):
    c, rng = index.codes, np.random.default_rng(3)
    x, q = vecindex.unit(clusters(500, 32, 40, 1).astype(np.float32)), vecindex.unit(rng.normal(size=(9, 32)).astype(np.float32))
    near = c.near(x)[:, 0]
    codes = c.encode(x, near)
    estimate = (q @ c.centre.T)[:, near] + c.tables(q)[:, np.arange(8)[None], codes].sum(2)
    assert np.abs(estimate - q @ x.T).max() < 0.35 and np.corrcoef(estimate.ravel(), (q @ x.T).ravel())[0, 1] > 0.95


def test_nothing(spark, questions, tmp_path):
    none = spark.createDataFrame([], "tenant_id string, doc_id long, embedding array<double>")
    assert vecindex.Index.build(none, str(tmp_path / "n")).search(questions).count() == 0
    one = spark.createDataFrame([("t", 1, [1.0] * 32)], "tenant_id string, doc_id long, embedding array<double>")
    index = vecindex.Index.build(one, str(tmp_path / "o"))
    assert index.search(questions).filter("doc_id = 1").count() == 30 and index.search(questions.limit(0)).count() == 0
    with pytest.raises(Exception, match="another length"):
        vecindex.Index.build(one.unionByName(spark.createDataFrame([("t", 2, [1.0])], one.schema)), str(tmp_path / "bad"))


def test_whole_second_look_stays_in_its_task(vectors, questions, index):
    """With a pool as large as the index each question brings no more than its best k out of a task, and few lists stay few lists."""
    asked = questions.filter("query_id < 20")
    assert index._looked(asked, 10**6, 5).count() == 100
    want = {(r.query_id, r.doc_id): r.similarity for r in index.search(asked, 5, probes=2, pool=2900).collect()}
    got = {(r.query_id, r.doc_id): r.similarity for r in index.search(asked, 5, probes=2, pool=10**6).collect()}
    assert got == want


def test_best_rows_of_a_task():
    """Vectors in many batches, most of them copies: a task sends each question its k best rows, whatever the number of batches."""
    import pyarrow as pa

    best = Best(2, 3)
    x = np.array([[1.0, 0.0], [0.0, 1.0]])
    for at in range(50):
        rows = [[1.0, 0.1 * ((at + j) % 3)] for j in range(40)]
        own = pa.RecordBatch.from_arrays([pa.array(range(at * 40, at * 40 + 40)), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "embedding"])
        vector.meet(best, own, np.array([0, 1]), x)
    out = pa.Table.from_batches(best.batches("cosine")).to_pylist()
    assert sorted(r["doc_id"] for r in out if r["_q"] == 0) == [0, 3, 6] and {round(r["cosine"], 4) for r in out if r["_q"] == 0} == {1.0}
    assert len(out) == 6
