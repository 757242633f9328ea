"""Quantiles without all values of a group in one place: a mergeable sketch with an error bound, and the exact values by narrowing ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import file_system, fresh_dir

#: Cells into which a range is cut in each pass, and values of a range that are sorted in one place.
CELLS, LEAF = 4096, 1024


def sketched(df: DataFrame, value: str, probabilities: Sequence[float], by: tuple[str, ...] = (), error: float = 0.001) -> DataFrame:
    """(*by, n, q): values whose rank is off by ``error`` x n and one row at most. Tasks send sketches of about 1 / error numbers, which merge. Nulls are left out."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(F.col(value).cast("double"), list(probabilities), max(1, round(1 / error))).alias("q"))


def exact(df: DataFrame, value: str, probabilities: Sequence[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, n, q): quantiles between neighbours of the sorted values, as ``percentile`` gives them, groups of any size. Nulls, NaN and
    infinite values are left out.

    The values at the two ranks of each probability are found by ranges: a pass counts ``CELLS`` cells of each range, and the cell that has the
    rank is the next range, from its least value to its greatest. A range of ``LEAF`` values or of one value ends it. Groups are rows of a
    table, so there may be many; tables between passes are in the shared folder.
    """
    spark = df.sparkSession
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.col(value).cast("double").alias("v")).where(F.abs("v") < float("inf"))
    rows = rows.withColumn("g", F.xxhash64(F.lit(0), *(F.coalesce(F.col(n).cast("string"), F.lit("\x00")) for n in names)))
    groups = rows.groupBy("g", *names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array(*(F.lit(float(p)) for p in probabilities))
    places = F.transform(wanted, lambda p: p * (F.col("n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(places, lambda x: F.floor(x)), F.transform(places, lambda x: F.ceil(x))))

    base, kept = fresh_dir(spark, "quantiles"), []

    def staged(table: DataFrame) -> DataFrame:
        path = f"{base}/{len(kept)}"
        table.write.parquet(path)
        kept.append(path)
        return spark.read.parquet(path)

    groups = staged(groups)
    state = staged(groups.select("g", F.explode(ranks).alias("r"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    many = (F.col("inside") > LEAF) & (F.col("lo") < F.col("hi"))

    def in_ranges(ranges: DataFrame) -> DataFrame:
        """Each value beside the ranges of its group that have it."""
        own = ranges.groupBy("g").agg(F.collect_list(F.struct("r", "lo", "hi", "below")).alias("s"))
        return rows.select("g", "v").join(own, "g").select("g", "v", F.explode(F.filter("s", lambda s: (F.col("v") >= s["lo"]) & (F.col("v") <= s["hi"]))).alias("s")).select("g", "v", "s.*")

    while not state.where(many).isEmpty():
        width = (F.col("hi") / CELLS - F.col("lo") / CELLS)
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("v") - F.col("lo")) / F.greatest(width, F.lit(5e-324))))
        counts = in_ranges(state.where(many)).groupBy("g", "r", "below", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("g", "r").orderBy("cell"))  # CELLS rows at most
        found = counts.withColumn("upto", F.col("below") + upto).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("c")))
        found = found.select("g", "r", "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("inside"))
        state = staged(state.where(~many).unionByName(found))
    one = state.where(F.col("lo") == F.col("hi")).select("g", "r", F.col("lo").alias("x"))
    few = in_ranges(state.where(F.col("lo") < F.col("hi"))).groupBy("g", "r", "below").agg(F.sort_array(F.collect_list("v")).alias("v"))
    few = few.select("g", "r", F.get("v", (F.col("r") - F.col("below")).cast("int")).alias("x"))
    at = one.unionByName(few).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("at"))
    # As the built-in aggregate weighs the two neighbours.
    between = lambda x: F.when(F.floor(x) == F.ceil(x), F.col("at")[F.floor(x)]).otherwise((F.ceil(x) - x) * F.col("at")[F.floor(x)] + (x - F.floor(x)) * F.col("at")[F.ceil(x)])
    out = staged(groups.join(at, "g").select(*names, "n", F.transform(places, between).alias("q")))
    for path in kept[:-1]:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    return out.toDF(*by, "n", "q")
