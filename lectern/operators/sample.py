"""Seeded splits and samples, by hash order: the same rows in any run and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def seeded(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary"))


#: Hexadecimal digits of the seeded order that cut a stratum into parts.
DIGITS = 3


def seeded_places(rows: DataFrame, key: str, strata: tuple[str, ...], seed: int) -> DataFrame:
    """``rows`` with ``_place`` (from 1, in seeded order) and ``_size`` of their stratum, and the order ``_h`` itself.

    No task orders a stratum: the seeded order is cut into 16^DIGITS parts, whose sizes are added up, and only a part's own
    rows are ordered. A null is a stratum of its own.
    """
    own = rows.withColumns({"_h": seeded(F.col(key), seed), "_s": F.to_json(F.struct(F.lit(1).alias("of"), *strata))})
    own = own.withColumn("_part", F.conv(F.substring("_h", 1, DIGITS), 16, 10).cast("int"))
    sizes = own.groupBy("_s", "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_s")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_s", "_part", before.alias("_before"), F.sum("_n").over(w).alias("_size"))
    inside = F.row_number().over(Window.partitionBy("_s", "_part").orderBy("_h", key))
    return own.withColumn("_in", inside).join(sizes, ["_s", "_part"]).withColumn("_place", F.col("_before") + F.col("_in")).drop("_s", "_part", "_in", "_before")


def stratified_split(rows: DataFrame, key: str, strata: tuple[str, ...], ratio: float = 0.7, seed: int = 42) -> DataFrame:
    """``fold``: train for the first round(n * ratio, half even) rows of each stratum in seeded order, else eval."""
    placed = seeded_places(rows, key, strata, seed)
    return placed.withColumn("fold", F.when(F.col("_place") <= F.bround(F.col("_size") * F.lit(ratio)), "train").otherwise("eval")).select(*rows.columns, "fold")


def stratified_sample(rows: DataFrame, key: str, strata: tuple[str, ...], total: int, seed: int = 42) -> DataFrame:
    """``total`` rows: each stratum gives its rounded share (at least one), then topped up or trimmed in seeded order."""
    n = rows.count()
    quota = F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(total / max(n, 1))))
    placed = seeded_places(rows, key, strata, seed).withColumn("_spare", (F.col("_place") > quota).cast("int"))
    return placed.orderBy("_spare", "_h", key).limit(total).select(rows.columns)


def quota_sample(rows: DataFrame, key: str, group: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """As many rows of each group as its quota, by an order seeded with the group's name; ``slot`` is the shuffled place over all."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(group)), F.lit(0))
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group), F.col(key).cast("string")).cast("binary")), key)
    taken = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return taken.withColumn("slot", F.row_number().over(Window.orderBy(seeded(F.concat_ws("|", F.col(group), F.col(key).cast("string")), seed + 1))))


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)
