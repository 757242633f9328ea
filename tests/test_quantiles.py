"""Exact and sketched quantiles, sub-samples by sketches, and counts of a run, against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import metrics, quantiles, resample

AT = (0.0, 0.1, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("cells, leaf", [(4096, 1024), (4, 3)])
def test_exact_quantiles(spark, monkeypatch, cells, leaf):
    """Many passes, ties, one value, few values, negative and tiny ones, groups with a null name."""
    monkeypatch.setattr(quantiles, "CELLS", cells)
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 5) for _ in range(400)], "b": [1.5] * 50, "c": [3.0], None: [rng.choice([1e-300, -1e-300, 1e300, 0.0]) for _ in range(90)], "d": [float(i // 30) for i in range(200)] + [None, float("nan"), float("inf")]}
    rows = [(g, v, i % 3) for g, own in groups.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(5)
    got = {r.g: (r.n, r.q) for r in quantiles.exact(df, "v", AT, ("g",)).collect()}
    for g, own in groups.items():
        own = [v for v in own if v is not None and np.isfinite(v)]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(np.quantile(own, AT).tolist(), rel=1e-12, abs=1e-308), g
    assert quantiles.exact(df.where("g = 'a'"), "v", (0.5,)).first().q[0] == pytest.approx(np.median(groups["a"]))
    assert quantiles.exact(df.where("false"), "v", AT, ("g",)).count() == 0


def test_sketch_error(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.pow(F.col("id") % 1000, 2.0).alias("v")).repartition(7)
    for r in quantiles.sketched(df, "v", AT, ("g",), 0.01).collect():
        own = np.array([float(i % 1000) ** 2 for i in range(50_000) if i % 2 == r.g])
        for p, q in zip(AT, r.q):
            assert (own < q).mean() <= p + 0.01 and (own <= q).mean() >= p - 0.01


def test_least_hashed(spark):
    """Sketches of many small batches and tasks give what sorting every key gives."""
    keys = [f"q{i}" for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = collections.defaultdict(list)
        for r in resample.least_hashed(spark.createDataFrame([(k,) for k in keys], "qa_id string").repartition(3), 7, 12).orderBy("rep", "place").collect():
            got[r.rep].append(r.qa_id)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {rep: sorted(keys, key=lambda k: (hashlib.md5(f"{rep}-{k}".encode()).hexdigest(), k))[:7] for rep in range(12)}
    few = resample.least_hashed(spark.createDataFrame([(3,), (1,)], "qa_id long"), 7, 2)
    assert few.count() == 4 and dict(few.dtypes)["qa_id"] == "bigint"
    assert resample.least_hashed(few.select("qa_id").where("false"), 7, 2).count() == 0


def test_distribution(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1), (None, 2)], "t string, d int")
    got = {(r.dimension, r.level): (r.n, r.share) for r in metrics.distribution(df, ("t", "d")).collect()}
    assert got == {("all", "all"): (4, 1.0), ("t", "a"): (2, 0.5), ("t", "b"): (1, 0.25), ("t", "null"): (1, 0.25), ("d", "1"): (2, 0.5), ("d", "2"): (1, 0.25), ("d", "null"): (1, 0.25)}
