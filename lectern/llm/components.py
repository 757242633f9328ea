"""Connected components of an undirected link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch, join_long_counts


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Each (u, v) with the least neighbour of u, u included. The minimum is pre-aggregated, and hubs are spread."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_long_counts(edges, ["u"], least, "n", total)


def connected_components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(id, component): every id on a link, with the least id that links reach from it.

    Ids that are on no link are not returned. Null ends and loops are ignored, repeated
    links count once, and an empty table gives an empty result. Every round is written to
    the shared folder, so a lost executor costs at most one round.
    """
    scratch = Scratch(links.sparkSession, "components")

    def between(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = scratch.stage(between(links.select(F.col(x).cast("long").alias("u"), F.col(y).cast("long").alias("v"))), "edges")
    state = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state()
    while total := before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.stage(between(_with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        # Both ends go to the least neighbour, out of one pass: a second one would plan and run all of this again.
        ends = F.explode(F.array(F.col("v"), F.col("u")))
        new = scratch.stage(between(_with_least(large, total).select(ends.alias("u"), F.col("m").alias("v"))), "edges")
        scratch.drop(edges, large)
        edges = new
        now = state()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
