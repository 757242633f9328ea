"""Bootstrap intervals, rank stability and rank correlation.

Two streams of indices: ``exact`` replays NumPy's seeded generator for a group in one task, its memory bounded by
blocks; ``hashed`` derives index (replicate, row) from md5, so any engine draws the same rows, and aggregates
in parallel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.statistics import bootstrap_ci


def hashed_index(replicate: Column, row: Column, n: Column) -> Column:
    """32 bits of md5('replicate-row') modulo n."""
    head = F.conv(F.substring(F.md5(F.concat(replicate.cast("string"), F.lit("-"), row.cast("string")).cast("binary")), 1, 8), 16, 10)
    return head.cast("long") % n


#: Draws of one piece, and rows of one block: an offset in a block takes two bytes.
PIECE, BLOCK = 1 << 20, 1 << 16


def _heads(texts: list[bytes]) -> np.ndarray:
    """The first 32 bits of each text's md5."""
    return np.frombuffer(b"".join([hashlib.md5(t).digest() for t in texts]), ">u4")[::4]


def _tasks(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _intervals(rows: DataFrame, means: DataFrame, alpha: float) -> DataFrame:
    """(n, mean, low, high, p_positive) of the values ``v`` and the replicates' means ``m``."""
    interval = means.agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"), F.avg((F.col("m") > 0).cast("double")).alias("p_positive"))
    return rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean")).crossJoin(interval).select("n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_positive")


def hashed_bootstrap(values: DataFrame, value: str, order: str, replicates: int = 1000, alpha: float = 0.05) -> DataFrame:
    """(n, mean, low, high, p_positive). Rows are numbered by ``order``; replicates run in parallel and only their sums meet.

    All replicates x n draws are made, in pieces; a draw goes to its row's block as an offset of two bytes, packed by piece, and a block's
    task adds up its own rows. Null values count as no row of a replicate's mean.
    """
    plain = values.select(F.col(value).cast("double").alias("v"), F.col(order).alias("_order"))
    rows, n = numbered(plain, "_order", out="i").select("i", "v"), plain.count()
    spark = values.sparkSession
    each = -(-n // PIECE)

    def draw(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                rep, first = x // each, x % each * PIECE
                at = _heads([b"%d-%d" % (rep, j) for j in range(first, min(n, first + PIECE))]).astype(np.int64) % n
                at.sort()
                cuts = np.flatnonzero(np.diff(at // BLOCK)) + 1
                offsets = np.split((at % BLOCK).astype("<u2"), cuts)
                blocks = at[np.concatenate([[0], cuts])] // BLOCK
                yield pa.record_batch([pa.array(blocks), pa.array([rep] * len(blocks), pa.int64()), pa.array([o.tobytes() for o in offsets], pa.binary())], names=["block", "rep", "offsets"])

    def add(draws: pa.Table, own: pa.Table) -> pa.Table:
        v, known = np.zeros(BLOCK), np.zeros(BLOCK, bool)
        at = own.column("i").to_numpy() % BLOCK
        v[at], known[at] = own.column("v").to_numpy(), True
        sums, counts = np.zeros(replicates), np.zeros(replicates, np.int64)
        for rep, offsets in zip(draws.column("rep").to_pylist(), draws.column("offsets")):
            at = np.frombuffer(offsets.as_buffer(), "<u2")
            sums[rep] += v[at].sum()
            counts[rep] += known[at].sum()
        return pa.table({"rep": np.arange(replicates), "s": sums, "c": counts})

    pieces = spark.range(0, replicates * each, 1, max(1, min(replicates * each, _tasks(values))))
    drawn = pieces.mapInArrow(draw, "block long, rep long, offsets binary").groupBy("block")
    own = rows.where(F.col("v").isNotNull()).withColumn("block", F.floor(F.col("i") / BLOCK)).groupBy("block")
    sums = drawn.cogroup(own).applyInArrow(add, "rep long, s double, c long")
    means = sums.groupBy("rep").agg((F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("m"))
    return _intervals(plain, means, alpha)


def exact_bootstrap(values: DataFrame, by: tuple[str, ...], value: str, order: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(*by, n, mean, low, high, p_positive) with NumPy's stream. A group of values (not of texts) meets in one task: its
    order is what the stream indexes. Groups beyond memory take :func:`hashed_bootstrap`."""
    kinds = dict(values.dtypes)

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values(order, kind="stable")[value].to_numpy(np.float64)
        return pd.DataFrame([(*key, len(v), *bootstrap_ci(v, replicates, alpha, seed))], columns=[*by, "n", "mean", "low", "high", "p_positive"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + (", " if by else "") + "n long, mean double, low double, high double, p_positive double"
    return values.select(*by, order, F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(run, schema)


def paired(treated: DataFrame, control: DataFrame, on: str, value: str) -> DataFrame:
    return treated.select(on, F.col(value).alias("treated")).join(control.select(on, F.col(value).alias("control")), on).withColumn("delta", F.col("treated") - F.col("control"))


def least_hashed(keys: DataFrame, sample: int, replicates: int) -> DataFrame:
    """(rep, place, <key>): for each replicate the ``sample`` keys of least md5('replicate-key'), ties by key; keys are distinct.

    Each task keeps a sketch: the least ``sample`` hashes of each replicate so far. Sketches are merged by keeping the least again, so at most
    tasks x replicates x sample rows meet, and nothing is sorted but these.
    """
    key, kind = keys.columns[0], keys.dtypes[0][1]
    text = keys.select(F.col(key), F.col(key).cast("string").alias("_text"))

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen: list[pa.Array] = []
        n = 0
        for batch in batches:
            texts = [b"-" + t.encode() for t in batch.column(1).to_pylist()]
            seen.append(batch.column(0))
            place = np.arange(n, n + len(texts))
            n += len(texts)
            for rep in range(replicates):
                head = str(rep).encode()
                digest = np.frombuffer(b"".join(hashlib.md5(head + t).digest() for t in texts), ">u8").reshape(-1, 2)
                if rep in held:
                    old, at = held[rep]
                    high = old[-1, 0] if len(old) >= sample else np.uint64(2**64 - 1)
                    few = digest[:, 0] <= high
                    digest, at = np.concatenate([old, digest[few]]), np.concatenate([at, place[few]])
                else:
                    at = place
                # All that tie with the last stay: which key comes first is told where sketches meet.
                order = np.lexsort((digest[:, 1], digest[:, 0]))
                if len(order) > sample:
                    last = digest[order[sample - 1]]
                    order = order[: int(np.searchsorted(digest[order, 0], last[0], "right"))]
                held[rep] = digest[order], at[order]
            # Only keys that some sketch still has are kept.
            if len(seen) > 64:
                used = np.unique(np.concatenate([at for _, at in held.values()]))
                seen, n = [pa.concat_arrays(seen).take(pa.array(used))], len(used)
                held = {rep: (d, np.searchsorted(used, at)) for rep, (d, at) in held.items()}
        if not held:
            return
        every = pa.concat_arrays(seen)
        for rep, (digest, at) in held.items():
            raw = digest.astype(">u8").tobytes().hex()
            yield pa.record_batch([pa.array([rep] * len(at), pa.int64()), pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.string()), every.take(pa.array(at))], names=["rep", "hash", key])

    w = Window.partitionBy("rep").orderBy("hash", key)
    return text.mapInArrow(run, f"rep long, hash string, {key} {kind}").withColumn("place", F.row_number().over(w)).where(F.col("place") <= sample).select("rep", "place", key)


def stability(scores: DataFrame, sample: int, replicates: int = 1000) -> DataFrame:
    """Ranks of systems in sub-samples of queries without replacement: scores(system, qa_id, value) -> (rep, system, mean, rk).

    A sub-sample is the ``sample`` queries of least md5('replicate-query').
    """
    taken = least_hashed(scores.select("qa_id").where("qa_id is not null").distinct(), sample, replicates).select("rep", "qa_id")
    means = taken.join(scores, "qa_id").groupBy("rep", "system").agg(F.round(F.avg("value"), 9).alias("mean"))
    return means.withColumn("rk", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("mean"), "system")))


def kendall(ranks: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("rep",), name: str = "system") -> DataFrame:
    """(*by, inversions, tau) of rankings against a reference(name, rk): pairs of systems, of which there are few."""
    ref = reference.select(F.col(name), F.col("rk").alias("ref"))
    rows = ranks.select(*by, name, "rk").join(ref, name)
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    on = F.col("a.ref") < F.col("b.ref")
    for s in same:
        on = on & s
    pairs = a.join(b, on)
    flipped = F.sum((F.col("a.rk") > F.col("b.rk")).cast("long"))
    return pairs.groupBy(*(F.col(f"a.{c}").alias(c) for c in by)).agg(flipped.alias("inversions"), (1 - 2 * flipped / F.count("*")).alias("tau"))


def average_ranks(rows: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean. Equal values are counted first, so ties of any number are one row."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    before = _running(counts, value, "_n", by)
    ranks = before.select(*by, F.col(value).alias("_value"), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    same = F.col(value).eqNullSafe(F.col("_value"))
    for c in by:
        ranks = ranks.withColumnRenamed(c, f"_by_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(ranks, same).drop("_value", *(f"_by_{c}" for c in by))


#: Cells into which a column's range is cut for running sums.
CELLS = 1024


def _running(rows: DataFrame, order: str, count: str, by: tuple[str, ...] = (), then: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``_before``: the sum of ``count`` of all rows before it in the order of a numeric column (then of others).

    No window has all rows: the column's range is cut into ``CELLS`` cells, whose sums (few rows) are added up, and only a
    cell's own rows are ordered.
    """
    bounds = rows.groupBy(*by).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    wide = rows.join(F.broadcast(bounds), list(by)) if by else rows.crossJoin(F.broadcast(bounds))  # a row for each group
    width = (F.col("_high") - F.col("_low")).cast("double") / CELLS
    cell = F.when(width > 0, F.least(F.floor((F.col(order) - F.col("_low")).cast("double") / width), F.lit(CELLS - 1))).otherwise(F.lit(0))
    wide = wide.withColumn("_cell", F.coalesce(cell, F.lit(-1)).cast("int")).drop("_low", "_high")
    sums = wide.groupBy(*by, "_cell").agg(F.sum(count).alias("_sum"))
    # Bucketed by a constant where there is no group: CELLS rows.
    until = Window.partitionBy(*(by or (F.lit(0),))).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_cell", F.coalesce(F.sum("_sum").over(until), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_cell").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    out = wide.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return out.join(F.broadcast(sums), [*by, "_cell"]).withColumn("_before", F.col("_offset") + F.col("_inside")).drop("_cell", "_offset", "_inside")


def numbered(rows: DataFrame, order: str, *then: str, out: str = "i") -> DataFrame:
    """``rows`` with their number from 0 in the order of a numeric column, then of others."""
    return _running(rows.withColumn("_one", F.lit(1)), order, "_one", (), then).withColumn(out, F.col("_before").cast("long")).drop("_before", "_one")


#: The distribution function of a Poisson variable of mean 1, up to 7.
POISSON = tuple(float(x) for x in np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(8)]))


def poisson_bootstrap(values: DataFrame, value: str, key: str, replicates: int = 1000, alpha: float = 0.05) -> DataFrame:
    """(n, mean, low, high, p_positive) with independent Poisson weights of mean 1 for each row and replicate.

    The weight comes from md5('replicate-key'), so a row needs no number and no other row: one pass, of which only the sums of
    each replicate leave a task.
    """
    rows = values.select(F.col(value).cast("double").alias("v"), F.col(key).cast("string").alias("key"))
    steps = np.array(POISSON)

    def add(batches):
        for batch in batches:
            # As an expression has it: a null value has a weight, and a null key the greatest.
            v, keys = batch.column(0).fill_null(0.0).to_numpy(), batch.column(1).drop_null().to_pylist()
            there, ends = batch.column(1).is_valid().to_numpy(zero_copy_only=False), [b"-" + t.encode() for t in keys]
            sums = np.zeros((2, replicates))
            for rep in range(replicates):
                head, w = b"%d" % rep, np.full(len(v), len(POISSON))
                w[there] = np.searchsorted(steps, _heads([head + t for t in ends]) / float(1 << 32), "right")
                sums[:, rep] = (w * v).sum(), w.sum()
            yield pa.record_batch([pa.array(np.arange(replicates)), pa.array(sums[0]), pa.array(sums[1])], names=["rep", "s", "w"])

    # A small file is one task's otherwise; a row is two numbers.
    sums = rows.repartition(_tasks(values), "key").mapInArrow(add, "rep long, s double, w double")
    means = sums.groupBy("rep").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return _intervals(rows, means, alpha)


def in_points(interval: DataFrame, digits: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """Mean and interval of a bootstrap, and other columns, in percentage points."""
    return interval.select("n", *(F.round(F.col(c) * 100, digits).alias(f"{c}_pp") for c in ("mean", "low", "high")), "p_positive", *(F.round(F.col(c) * 100, digits).alias(f"{c}_pp") for c in also))


def significance(interval: DataFrame, reference: Column) -> DataFrame:
    """The interval with ``pct_change`` against a reference mean, and whether 0 is outside it."""
    return interval.withColumns({"pct_change": 100 * F.col("mean") / reference, "significant": (F.col("low") > 0) | (F.col("high") < 0)})


def seed_merged(values: DataFrame, seed: str, value: str, key: str, replicates: int = 1000) -> DataFrame:
    """One interval over the paired differences of all runs, and ``seed_std``: the sample deviation of the runs' own means."""
    merged = hashed_bootstrap(values, value, key, replicates)
    spread = values.groupBy(seed).agg(F.avg(value).alias("m")).agg(F.stddev_samp("m").alias("seed_std"), F.count("*").alias("seeds"))
    return merged.crossJoin(spread)
