"""From ranked lists to the per-query cube and its aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

K_VALUES = (1, 5, 10)


def first_hits(queries: DataFrame, ranked: DataFrame, relevant: Column, by: tuple[str, ...] = ("qa_id",)) -> DataFrame:
    """(*by, pos): the first relevant rank, null where none is; every query of ``queries`` has a row."""
    hits = ranked.where(relevant).groupBy(*by).agg(F.min("rk").alias("pos"))
    return queries.select(*by).join(hits, list(by), "left")


def hit_at(pos: Column, k: Column) -> Column:
    return F.coalesce((pos <= k).cast("double"), F.lit(0.0))


def mrr_at(pos: Column, k: Column) -> Column:
    return F.when(pos <= k, F.lit(1.0) / pos).otherwise(0.0)


def ndcg_at(pos: Column, k: Column) -> Column:
    """With one relevant row: the discount of its rank."""
    return F.when(pos <= k, 1.0 / F.log2(pos + 1)).otherwise(0.0)


def cube(hits: DataFrame, ks: tuple[int, ...] = K_VALUES) -> DataFrame:
    """One row for each k: hit, mrr, ndcg (recall equals hit here)."""
    rows = hits.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    pos, k = F.col("pos"), F.col("k")
    return rows.withColumns({"hit": hit_at(pos, k), "mrr": mrr_at(pos, k), "ndcg": ndcg_at(pos, k)})


def rcps(per_qa: DataFrame, by: tuple[str, ...] = (), retriever: str = "retriever") -> DataFrame:
    """Mean MRR over the cells (retriever, k), each the mean over its queries; the mean of nothing is 0, an empty group has no row."""
    cells = per_qa.groupBy(*by, retriever, "k").agg(F.avg("mrr").alias("mrr"), F.avg(F.when(F.col("k") == 1, F.col("hit"))).alias("hit1"))
    return cells.groupBy(*by).agg(mean("mrr").alias("rcps"), mean("hit1").alias("hit1"))


def mean(column: str) -> Column:
    """The mean, 0 of nothing."""
    return F.coalesce(F.avg(column), F.lit(0.0))


def hit_of_mrr(mrr: Column) -> Column:
    """Whether there was a hit, where only the reciprocal rank is stored."""
    return (mrr > 0).cast("double")


#: What a named series takes of the cells (metric, k).
SERIES = {
    "rcps": lambda metric, k: metric == "mrr",
    "hit@1": lambda metric, k: (metric == "mrr") & (k == 1),
    "mrr@10": lambda metric, k: (metric == "mrr") & (k == 10),
}


def series(cells: DataFrame, name: str, by: tuple[str, ...] = ("system",)) -> DataFrame:
    """(*by, qa_id, value): a named series of cells(*by, qa_id, metric, k, value), the mean of the cells that it takes."""
    return cells.where(SERIES[name](F.col("metric"), F.col("k"))).groupBy(*by, "qa_id").agg(mean("value").alias("value"))


def by_family(scores: DataFrame, names: list[tuple[str, str, str]], key: str) -> DataFrame:
    """``scores`` with the family and severity of their name: (family, severity, name) of each, a small table."""
    table = scores.sparkSession.createDataFrame(names, f"family string, severity string, {key} string")
    return scores.join(F.broadcast(table), key)


def page_attribution(diffs: DataFrame, pages: DataFrame, value: str = "diff", key: str = "qa_id") -> DataFrame:
    """(page_id, n_qa, mean_diff_pp): per-query differences by the page of their query."""
    rows = diffs.select(key, value).join(pages.select(key, "page_id"), key)
    return rows.groupBy("page_id").agg(F.count("*").alias("n_qa"), F.round(100 * F.avg(value), 3).alias("mean_diff_pp"))


def best_rows(rows: DataFrame, value: str, name: str, n: int) -> DataFrame:
    """The ``n`` rows of the greatest value, ties by name."""
    return rows.orderBy(F.desc(value), name).limit(n)


def per_qa_rcps(per_qa: DataFrame, by: tuple[str, ...] = ("qa_id",)) -> DataFrame:
    return per_qa.groupBy(*by).agg(F.avg("mrr").alias("rcps"))


def subgroup_deltas(paired: DataFrame, dimensions: tuple[str, ...], least: int = 8) -> DataFrame:
    """(dimension, level, n, delta) of paired(treated, control, dimensions...), groups of ``least`` rows or more."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dimensions))).alias("d")
    return paired.select(pairs, (F.col("treated") - F.col("control")).alias("diff")).groupBy("d.dimension", "d.level").agg(F.count("*").alias("n"), F.avg("diff").alias("delta")).where(F.col("n") >= least)


def change_shares(paired: DataFrame) -> DataFrame:
    diff = F.col("treated") - F.col("control")
    share = lambda c: F.avg(c.cast("double")) * 100
    return paired.agg(F.count("*").alias("n"), share(diff > 0).alias("improved"), share(diff < 0).alias("degraded"), share(diff == 0).alias("unchanged"))


def ranking(rows: DataFrame, name: str, score: str, by: tuple[str, ...] = (), fixed: tuple[str, ...] | None = None) -> DataFrame:
    """Rank by score, best first; ties by name, or by a fixed order of names."""
    from pyspark.sql import Window

    tie = F.array_position(F.array(*(F.lit(x) for x in fixed)), F.col(name)) if fixed else F.col(name)
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def distribution(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(dimension, level, n, share): how many rows there are, and how many with each value of each dimension, in one pass. Null is a level of its own, 'null'."""
    text = {d: F.coalesce(F.col(d).cast("string"), F.lit("null")) for d in dimensions}
    sets = rows.select(*(c.alias(d) for d, c in text.items())).groupingSets([[], *([d] for d in dimensions)], *dimensions).agg(F.count("*").alias("n"), *(F.grouping(d).alias(f"_{d}") for d in dimensions))
    dimension, level = F.lit("all"), F.lit("all")
    for d in dimensions:
        dimension, level = F.when(F.col(f"_{d}") == 0, d).otherwise(dimension), F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(level)
    counts = sets.select(dimension.alias("dimension"), level.alias("level"), "n")
    total = counts.where("dimension = 'all'").select(F.col("n").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("dimension", "level", "n", F.coalesce(F.try_divide(F.col("n"), F.col("_total")), F.lit(0.0)).alias("share"))
