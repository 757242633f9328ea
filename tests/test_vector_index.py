"""The grid of dense products and the partitioned index, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieve, vector_index


def vectors(spark, n, dims, clusters, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    at = rng.integers(0, clusters, n)
    at[: n // 3] = 0  # one list has a third of all rows
    v = centres[at] + 0.4 * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "chunk_id long, embedding array<float>")


def brute(v, asked, k, skip_self=False):
    v = v.astype(np.float32).astype(np.float64)
    out = {}
    for i in asked:
        s = np.round(v @ v[i], 6)
        if skip_self:
            s[i] = -np.inf
        out[i] = np.lexsort((np.arange(len(v)), -s))[:k].tolist()
    return out


def listed(df, query="qa_id"):
    out = {}
    for r in df.orderBy("rk").collect():
        out.setdefault(r[query], []).append(r.chunk_id)
    return out


def test_grid_is_all_pairs(spark, monkeypatch):
    """Many blocks on both sides, few documents for each product; the driver runs no loop over queries."""
    v, df = vectors(spark, 300, 8, 5)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 13)
    monkeypatch.setattr(retrieve, "DOC_BLOCK", 40)
    monkeypatch.setattr(retrieve, "STEP", 7)
    q = df.withColumnRenamed("chunk_id", "qa_id").where("qa_id < 60")
    for skip in (False, True):
        assert listed(retrieve.top_k(retrieve.dense_scores(q, df, 5, skip_self=skip), 5)) == brute(v, range(60), 5, skip)
    scores = retrieve.dense_scores(q, df, 5)
    assert "toLocalIterator" not in open(retrieve.__file__).read()
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("CoGroup") == 1


def test_grid_of_odd_rows(spark):
    """Rows without a vector, ties at the cut, repeated ids, text ids, and nothing on either side."""
    one = [1.0, 0.0]
    df = spark.createDataFrame([(c, v) for c in "abcde" for v in (one,)] + [("z", None), ("y", [0.0, 1.0]), ("a", one)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("a", one), ("q", [0.0, 1.0]), ("n", None)], "qa_id string, embedding array<float>")
    got = listed(retrieve.top_k(retrieve.dense_scores(q, df, 3), 3))
    assert got["q"][0] == "y" and got["a"] == ["a", "a", "b"] and set(got) == {"a", "q"}
    assert "a" not in listed(retrieve.top_k(retrieve.dense_scores(q, df, 3, skip_self=True), 3))["a"]
    assert retrieve.dense_scores(q.where("false"), df, 3).count() == retrieve.dense_scores(q, df.where("false"), 3).count() == 0


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "DOC_BLOCK", 50)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 16)
    v, df = vectors(spark, 600, 16, 12)
    extra = spark.createDataFrame([(9000, None), (None, [0.0] * 16)], df.schema)
    return v, df, vector_index.build(df.unionByName(extra), f"file://{tmp_path}/index", lists=12)


def test_index_has_every_row_once(index):
    v, df, found = index
    assert found.lists == 12 and sorted(r.chunk_id for r in found.rows.select("chunk_id").collect()) == list(range(600))
    sizes = found.rows.groupBy("list", "part").count().collect()
    assert max(r["count"] for r in sizes) < 100 and max(r.part for r in sizes) >= 1  # the large list is in parts


def test_all_lists_are_exact_search(index):
    v, df, found = index
    q = df.withColumnRenamed("chunk_id", "qa_id").where("qa_id % 7 = 0")
    for skip in (False, True):
        assert listed(found.search(q, 10, found.lists, skip_self=skip)) == brute(v, range(0, 600, 7), 10, skip)


def test_recall_of_some_lists(index):
    """The lists that a sample needs for 0.95 find 0.9 of the ten best of other queries, and are not all."""
    v, df, found = index
    probes = found.probes_for(0.95)
    assert 1 <= probes < found.lists
    q = df.withColumnRenamed("chunk_id", "qa_id").where("qa_id % 5 = 1")
    exact = retrieve.top_k(retrieve.dense_scores(q, df, 10), 10)
    row = vector_index.recall(found.search(q, 10, probes), exact, "qa_id", "chunk_id").first()
    assert row.asks == 120 and row.recall >= 0.9
    assert found.probes_for(1.0) >= probes


def test_index_opens_again(spark, index, tmp_path):
    v, df, found = index
    again = vector_index.open_index(spark, f"file://{tmp_path}/index")
    q = df.withColumnRenamed("chunk_id", "qa_id").where("qa_id < 20")
    assert listed(again.search(q, 5, 3)) == listed(found.search(q, 5, 3)) and np.allclose(again.centroids, found.centroids)


def test_empty_index(spark, index, tmp_path):
    v, df, _ = index
    none = vector_index.build(df.where("false"), f"file://{tmp_path}/none")
    q = df.withColumnRenamed("chunk_id", "qa_id").where("qa_id < 3")
    assert none.lists == 0 and none.search(q, 5, 3).count() == 0 and none.probes_for(0.9) == 0
    few = vector_index.build(df.where("chunk_id < 2"), f"file://{tmp_path}/few")
    assert listed(few.search(q.withColumn("embedding", F.when(F.col("qa_id") == 1, None).otherwise(F.col("embedding"))), 5, 9)).keys() == {0, 2}
