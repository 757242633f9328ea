"""Keyed state of a stream equals the table, over batches, a restart in the middle, late rows and quiet keys."""

import datetime
import random

from pyspark.sql import functions as F

from lectern.streaming import keyed

AT = datetime.datetime(2024, 5, 1)


def write(spark, path, rows):
    spark.createDataFrame(rows, "user long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(path)


def drain(spark, path, check, out, **how):
    stream = spark.readStream.schema("user long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(path)

    def each(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    keyed.latest(stream, "user", "ts", "value", **how).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def last(df):
    best = df.groupBy("user").agg(F.max(F.struct("batch", "at", "value", "n", "mean")).alias("b"))
    return sorted((r.user, r.b.at, r.b.value, r.b.n, round(r.b.mean, 9)) for r in best.collect())


def test_stream_equals_table_after_a_restart(spark, tmp_path):
    rng = random.Random(1)
    path, check, out = (f"file://{tmp_path}/{n}" for n in ("in", "check", "out"))
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), None if rng.random() < 0.03 else AT + datetime.timedelta(minutes=rng.randrange(500)), None if rng.random() < 0.05 else float(rng.randrange(50))) for _ in range(300)]
    for i in range(0, 150, 50):
        write(spark, path, rows[i : i + 50])
    drain(spark, path, check, out)
    for i in range(150, 300, 50):
        write(spark, path, rows[i : i + 50])
    got = last(drain(spark, path, check, out))
    want = keyed.summary(spark.createDataFrame(rows, "user long, ts timestamp, value double"), "user", "ts", "value")
    assert got == sorted((r.user, r.at, r.value, r.n, round(r.mean, 9)) for r in want.collect())


def test_quiet_keys_close(spark, tmp_path):
    path, check, out = (f"file://{tmp_path}/{n}" for n in ("in", "check", "out"))
    minutes = lambda m: AT + datetime.timedelta(minutes=m)
    for rows in ([(1, minutes(0), 1.0), (2, minutes(1), 5.0)], [(2, minutes(60), 7.0)], [(2, minutes(63), 8.0)], [(1, minutes(64), 9.0)]):
        write(spark, path, rows)
    got = drain(spark, path, check, out, quiet=datetime.timedelta(minutes=30))
    assert sorted((r.user, r.value, r.n) for r in got.where("closed").collect()) == [(1, 1.0, 1)]
    # A key that comes back begins anew.
    assert (1, 9.0, 1) in [(r.user, r.value, r.n) for r in got.where("not closed").collect()]
