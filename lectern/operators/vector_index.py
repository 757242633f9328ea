"""A partitioned index of vectors: lists around centroids, probed, with exact scores inside the lists.

Centroids are learned on a bounded sample; every row is assigned to the list of its nearest centroid and stored there. A query
probes the lists whose centroids have the highest product with it, and is scored exactly against all their rows. How many lists
are enough for a wanted recall is measured against exact search, on a bounded sample of rows as queries. Probing all lists is exact search.

Lists may be of any size: large ones are stored in parts, and many queries of one list in blocks, so a cell of work is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .retrieve import DOC_BLOCK, QUERY_BLOCK, best_in_cell, dense_scores, top_k

#: Rows on which centroids are learned, rounds of that, most lists (their centroids go to every task), and rows that ask when recall is measured.
SAMPLE, ROUNDS, MOST_LISTS, ASKED = 16_384, 12, 4_096, 128


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _sample(rows: DataFrame, id_col: str, vector: str, n: int) -> np.ndarray:
    """The vectors of the ``n`` rows of least hashed id (at least: rows of one id may be more)."""
    total = rows.count()
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), 11) / F.lit(float(1 << 53))
    some = rows.where(hashed < min(1.0, (2.0 * n + 100) / max(total, 1))) if total > n else rows
    got = some.orderBy(hashed, F.col(id_col)).select(vector).limit(n).toArrow().column(0)
    return got.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(got), -1) if len(got) else np.zeros((0, 0))


def learn_centroids(vectors: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Spherical k-means; an empty list takes the vector that is farthest from its centroid."""
    v = _unit(vectors)
    lists = min(lists, len(v))
    c = v[np.sort(np.random.default_rng(seed).choice(len(v), lists, replace=False))]
    for _ in range(rounds):
        near = v @ c.T
        at = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, v)
        empty = np.flatnonzero(np.bincount(at, minlength=lists) == 0)
        sums[empty] = v[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        c = _unit(sums)
    return c


def _ranked_lists(centroids, count: int, normal: bool):
    """The ``count`` best lists of each row (id, vector), best first."""
    def run(batches):
        c = centroids.value
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                v = flat.reshape(batch.num_rows, -1)[i : i + 1024]
                s = -(_unit(v) if normal else v) @ c.T
                best = np.argpartition(s, count - 1, axis=1)[:, :count] if count < len(c) else np.tile(np.arange(len(c)), (len(v), 1))
                best = np.take_along_axis(best, np.take_along_axis(s, best, 1).argsort(1, kind="stable"), 1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
                yield pa.record_batch([*part.columns, lists], names=[*part.schema.names, "lists"])

    return run


@dataclass
class VectorIndex:
    """``rows`` (list, part, id, vector) of a stored index, its centroids, and the names of id and vector."""

    rows: DataFrame
    centroids: np.ndarray
    id_col: str
    vector: str

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def search(self, queries: DataFrame, k: int, probes: int, query_id: str = "qa_id", skip_self: bool = False) -> DataFrame:
        """(query_id, id, score, rk): the ``k`` best rows of the lists that each query probes, scores exact, ties by id.

        Queries without a vector have no row. An empty index gives no row.
        """
        spark = self.rows.sparkSession
        asked = queries.select(query_id, F.col(self.vector)).where(F.col(self.vector).isNotNull())
        kinds = {query_id: dict(queries.dtypes)[query_id], self.id_col: dict(self.rows.dtypes)[self.id_col]}
        if not self.lists:
            return spark.createDataFrame([], f"{query_id} {kinds[query_id]}, {self.id_col} {kinds[self.id_col]}, score double, rk int")
        shared = spark.sparkContext.broadcast(self.centroids)
        schema = f"{query_id} {kinds[query_id]}, {self.vector} {dict(queries.dtypes)[self.vector]}, lists array<int>"
        probed = asked.mapInArrow(_ranked_lists(shared, min(probes, self.lists), False), schema).withColumn("list", F.explode("lists")).drop("lists")
        # Sizes of lists: as many rows as there are centroids, so they can go to every task.
        parts = self.rows.groupBy("list").agg(F.max("part").alias("parts"))
        blocks = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        left = probed.join(F.broadcast(blocks), "list").join(F.broadcast(parts), "list")
        left = left.withColumn("block", F.pmod(F.xxhash64(F.col(query_id).cast("string")), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts"))))
        right = self.rows.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ("list", "part", "block")
        left, right = (side.select(*(F.col(c).alias(c) for c in (own, self.vector, *keys))).groupBy(*keys) for side, own in ((left, query_id), (right, self.id_col)))
        made = left.cogroup(right).applyInArrow(best_in_cell(k, (query_id, self.id_col), self.vector, skip_self), f"{query_id} {kinds[query_id]}, {self.id_col} {kinds[self.id_col]}, score double")
        return top_k(made, k, (query_id,), self.id_col)

    def probes_for(self, recall: float, k: int = 10, asked: int = ASKED) -> int:
        """The least number of lists with which ``asked`` rows of the index, as queries, find that part of their exact ``k`` best."""
        if not self.lists:
            return 0
        rows = self.rows.select(self.id_col, self.vector)
        hashed = F.xxhash64(F.col(self.id_col).cast("string"), F.lit(12))
        some = rows.orderBy(hashed, self.id_col).limit(asked).withColumnRenamed(self.id_col, "_asked")
        best = top_k(dense_scores(some, rows, k, query_id="_asked", doc_id=self.id_col, vector=self.vector), k, ("_asked",), self.id_col)
        at = best.join(self.rows.select(self.id_col, "list"), self.id_col).select("_asked", "list")
        spark = rows.sparkSession
        schema = f"_asked {dict(some.dtypes)['_asked']}, {self.vector} {dict(some.dtypes)[self.vector]}, lists array<int>"
        order = some.mapInArrow(_ranked_lists(spark.sparkContext.broadcast(self.centroids), self.lists, False), schema).select("_asked", "lists")
        # At most asked * k rows: the place of each wanted row's list in its query's order.
        places = [r[0] for r in at.join(order, "_asked").select(F.array_position("lists", F.col("list"))).collect()]
        return int(np.sort(places)[max(0, int(np.ceil(recall * len(places))) - 1)]) if places else self.lists


def build(docs: DataFrame, path: str, lists: int | None = None, id_col: str = "chunk_id", vector: str = "embedding", sample: int = SAMPLE) -> VectorIndex:
    """Store an index of all rows at ``path`` (Parquet, a folder for each list; beside it the centroids) and open it.

    ``lists`` (default: the square root of the number of rows, ``MOST_LISTS`` at most) centroids are learned on ``sample`` rows.
    Rows without a vector or an id are left out.
    """
    rows = docs.select(id_col, vector).dropna()
    wanted = min(lists or max(1, int(rows.count() ** 0.5)), MOST_LISTS)
    some = _sample(rows, id_col, vector, sample)
    centroids = learn_centroids(some, wanted) if len(some) else np.zeros((0, 0))
    spark = docs.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    if len(centroids):
        schema = f"{id_col} {dict(rows.dtypes)[id_col]}, {vector} {dict(rows.dtypes)[vector]}, lists array<int>"
        placed = rows.mapInArrow(_ranked_lists(spark.sparkContext.broadcast(centroids), 1, True), schema).withColumn("list", F.col("lists")[0]).drop("lists")
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"))  # a row for each centroid
        part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(13)), F.ceil(F.col("n") / DOC_BLOCK)).cast("int")
        placed = placed.join(F.broadcast(sizes), "list").withColumn("part", part).drop("n")
        placed.repartition("list", "part").write.partitionBy("list").parquet(f"{path}/rows")
    return open_index(spark, path, id_col, vector, f"{id_col} {dict(rows.dtypes)[id_col]}, {vector} {dict(rows.dtypes)[vector]}, part int, list int")


def open_index(spark: SparkSession, path: str, id_col: str = "chunk_id", vector: str = "embedding", schema: str | None = None) -> VectorIndex:
    found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    if not found:
        return VectorIndex(spark.createDataFrame([], schema or f"{id_col} long, {vector} array<float>, part int, list int"), np.zeros((0, 0)), id_col, vector)
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/rows")
    return VectorIndex(rows, np.array([r.centroid for r in found], np.float64), id_col, vector)


def recall(found: DataFrame, exact: DataFrame, query_id: str, item: str) -> DataFrame:
    """(asks, recall): the part of the exact rows that was found."""
    both = exact.select(query_id, item).join(found.select(query_id, item).withColumn("hit", F.lit(1)), [query_id, item], "left")
    return both.agg(F.countDistinct(query_id).alias("asks"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("recall"))
