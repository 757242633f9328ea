"""How much the driver has to plan and run: its memory follows jobs and plans, not rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import common, jaccard_join
from lectern.llm.components import connected_components


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_few_jobs_for_counts(spark):
    """The table of counts comes to the driver in a few jobs, not in one for each partition of the shuffle."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    counts = [np.full(jaccard_join.BLOCK, i % 200, np.uint8).tobytes() for i in range(64)]
    rows = spark.createDataFrame(pa.table({"block": pa.array(range(64), pa.int32()), "counts": pa.array(counts, pa.binary())}))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, jobs = _jobs(spark, "counts", lambda: jaccard_join._classes(rows))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert jobs <= 10
    # Most cells are empty, so the load is 0: class 0 up to 4, then one for each doubling.
    assert [int(got[i * jaccard_join.BLOCK]) for i in (0, 4, 5, 6, 8, 63)] == [0, 0, 1, 2, 3, 6] and not got[64 * jaccard_join.BLOCK :].any()


def test_join_long_counts(spark, monkeypatch):
    """The rows of the plain join: hot keys or not, keys that the table lacks, repeated rows, several keys; and rows are read once."""
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    rng = random.Random(1)
    rows = [(rng.choice([-1, 7, 7, 7, rng.randrange(30)]), i % 2, i // 2) for i in range(300)]
    rows = spark.createDataFrame(rows, "k long, s int, x int").repartition(5)
    own = rows.where("k <> 7 or s = 1").groupBy("k", "s").agg(F.count("*").alias("n"))
    table = own.select("k", "s", "n", (F.col("k") * 2).alias("m"), F.when(F.col("k") > 20, F.col("n")).alias("null_or_n"))
    for given in (table, table.drop("m", "null_or_n"), table.where("k < 0")):
        got = common.join_long_counts(rows, ["k", "s"], given, "n", 300)
        want = rows.join(given.drop("n"), ["k", "s"])
        assert got.columns == want.select(*rows.columns, *(c for c in want.columns if c not in rows.columns)).columns
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in want.select(got.columns).collect())
    plan = common.join_long_counts(rows, ["k", "s"], spark.range(9).select(F.col("id").alias("k"), F.lit(1).alias("s"), F.lit(9).alias("n")), "n", 9)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_components_of_any_graph(spark, monkeypatch):
    """Hubs at either end, long paths, loops and negative ids, with and without hot keys, as by union-find; stars need one round."""
    rng = random.Random(0)
    edges = [(rng.randrange(-60, 120), rng.randrange(-60, 120)) for _ in range(70)] + [(500, 501 + i) for i in range(40)]
    edges += [(900 + i, 899 + i) for i in range(20)] + [(3000, i + 2000) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    got = connected_components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert len(got) == len(want) and {r.id: r.component for r in got} == want
    stars = spark.createDataFrame([(x, c) for x, c in want.items() if x != c], "x long, y long")
    got, jobs = _jobs(spark, "stars", lambda: connected_components(stars))
    assert {r.id: r.component for r in got.collect()} == want and jobs <= 20, jobs
