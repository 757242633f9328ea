"""Quality by importance resampling.

Two generative models of hashed word n-grams (1 and 2 words, lower-cased A-Z) are counted: one of target
text (labelled good and not toxic), one of all raw text. The log importance weight of a document is
``log p_target(x) - log p_raw(x)``, the sum over its n-grams of the log ratio of their probabilities. Documents are
drawn without replacement by their weights: the ``k`` largest of ``log weight + Gumbel noise``, the noise being a
seeded hash of the id. Unless it is given, ``k`` is the sum of ``min(1, weight)``: as many as the target model expects
among the raw documents, so that text like the target stays whole, however much or little of the rest there is.

A cell's ratio is ``(target + s) / (raw * share + s)`` with ``share`` the part of all n-grams that is target
text: a rare n-gram says little, whichever model has it. The smoothing ``s`` is the least of ``SMOOTHS`` with which either half
of the target text, scored by the other half's model, would be drawn to ``HELD_OUT`` (else the one with which most would):
a small target says less about rare n-grams than a large one.

All documents are counted and scored. The model has ``BUCKETS`` cells for each n, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels
from .common import Scratch, _step, least_hashed, unit_hash

BUCKETS = 1 << 19
#: Occurrences that every cell may be taken to have beside its own, in either model, and the share of held-out target text that must be drawn.
SMOOTHS, HELD_OUT = (2.0, 4.0, 8.0, 16.0, 32.0), 0.8
#: The log ratio of a text without words.
NOTHING = -1000.0
#: Labelled good documents that the target model counts, at most, by least hashed id. The raw model counts all.
TARGET = 20_000
#: Cells that one row of the exchange of counts holds, and n-grams that a task holds before it counts them.
BLOCK, HELD = 1 << 13, 1 << 20


def _cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of 1-grams, cells of 2-grams or -1 across documents, first word of each document)."""
    h, at = kernels.hashed_words(data, offsets)
    one = (h % np.uint64(BUCKETS)).astype(np.int64)
    two = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        two[:-1] = (kernels.runs(h, 2) % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS
        lasts = at[1:][at[1:] > at[:-1]] - 1
        two[lasts] = -1
    return one, two, at


def _counts(batches):
    """(block, raw, one, two) of a task, as bytes of counts; column 1 marks target rows of the first half with 1, of the second with 2."""
    totals = np.zeros((3, 2 * BUCKETS), np.int64)
    held: tuple[list, list, list] = ([], [], [])
    size = 0

    def count():
        for total, cells in zip(totals, held):
            if cells:
                total += np.bincount(np.concatenate(cells), minlength=2 * BUCKETS)
                cells.clear()

    for batch in batches:
        marks = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in kernels.slices(batch.column(0)):
            one, two, at = _cells(data, offsets)
            mark = np.repeat(marks[i:j], np.diff(at))
            for cells in (one, two):
                held[0].append(cells[cells >= 0])
                for half in (1, 2):
                    if (mark == half).any():
                        held[half].append(cells[(cells >= 0) & (mark == half)])
            size += 2 * len(one)
            if size >= HELD:
                count()
                size = 0
    count()
    parts = totals.reshape(3, -1, BLOCK)
    used = np.flatnonzero(parts[0].any(1))
    yield pa.record_batch([pa.array(used.astype(np.int32)), *(pa.array([parts[k, i].astype(np.uint32).tobytes() for i in used], pa.binary()) for k in range(3))], names=["block", "raw", "one", "two"])


def _summed(batches):
    """The sum of each block that this task has; a running sum, not a gathered group."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, *counts in zip(*(c.to_pylist() for c in batch.columns)):
            got = np.stack([np.frombuffer(x, np.uint32).astype(np.int64) for x in counts])
            totals[block] = totals[block] + got if block in totals else got
    yield pa.record_batch([pa.array(list(totals), pa.int32()), *(pa.array([t[k].tobytes() for t in totals.values()], pa.binary()) for k in range(3))], names=["block", "raw", "one", "two"])


def _ratios(raw: np.ndarray, target: np.ndarray, share: float, smooth: float) -> np.ndarray:
    return np.log((target + smooth) / (raw * share + smooth))


def _held_out(shared):
    """(n, drawn) of a task: of target rows, scored by the other half's model, what each smoothing expects to draw."""
    def run(batches):
        counts, shares = shared.value
        n, drawn = 0, np.zeros(len(SMOOTHS))
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in kernels.slices(batch.column(0)):
                one, two, at = _cells(data, offsets)
                for d in range(i, j):
                    a, b = at[d - i], at[d - i + 1]
                    if b > a:
                        cells = np.concatenate([one[a:b], two[a:b][two[a:b] >= 0]])
                        other = 3 - int(marks[d])
                        raw, target = counts[0][cells], counts[other][cells]
                        sums = np.array([_ratios(raw, target, shares[other], s).sum() for s in SMOOTHS])
                        n, drawn = n + 1, drawn + np.exp(np.minimum(sums, 0.0))
        yield pa.record_batch([pa.array([n]), pa.array([drawn.tolist()], pa.list_(pa.float64()))], names=["n", "drawn"])

    return run


def _scores(shared):
    def run(batches):
        ratio = shared.value
        for batch in batches:
            sums, sizes = [], []
            for _, _, data, offsets in kernels.slices(batch.column(1)):
                one, two, at = _cells(data, offsets)
                value = ratio[one] + np.where(two >= 0, ratio[two], 0.0)
                total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
                sums.append(total[at[1:]] - total[at[:-1]])
                sizes.append(np.maximum(2 * np.diff(at) - 1, 0))
            s, n = (np.concatenate(x) if x else np.zeros(0) for x in (sums, sizes))
            yield pa.record_batch([batch.column(0), pa.array(np.where(n > 0, s, NOTHING)), pa.array(n, pa.int64())], names=["id", "ratio", "n_grams"])

    return run


def log_ratios(df: DataFrame, target: Column, text_col: str = "text") -> np.ndarray:
    """The log ratio of every cell; ``target`` is a column of ``df`` that marks target rows of two halves with 1 and 2."""
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.coalesce(target, F.lit(0)).cast("int").alias("target"))
    schema = "block int, raw binary, one binary, two binary"
    sums = rows.mapInArrow(kernels.tidy(_counts), schema).repartition("block").mapInArrow(kernels.tidy(_summed), schema)
    counts = np.zeros((3, 2 * BUCKETS), np.float32)
    with _step(df.sparkSession):
        for r in sums.toLocalIterator():  # 2 * BUCKETS counts of each model in all
            for k in range(3):
                counts[k, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r[k + 1], np.int64)
    total = max(float(counts[0].sum(dtype=np.float64)), 1.0)
    shares = [float(c.sum(dtype=np.float64)) / total for c in counts]
    shared = df.sparkSession.sparkContext.broadcast((counts, shares))
    with _step(df.sparkSession):
        found = rows.where("target > 0").mapInArrow(kernels.tidy(_held_out(shared)), "n long, drawn array<double>").agg(F.sum("n").alias("n"), *(F.sum(F.col("drawn")[i]).alias(f"d{i}") for i in range(len(SMOOTHS)))).first()
    drawn = [found[f"d{i}"] / found["n"] if found["n"] else 0.0 for i in range(len(SMOOTHS))]
    smooth = next((s for s, d in zip(SMOOTHS, drawn) if d >= HELD_OUT), SMOOTHS[int(np.argmax(drawn))])
    return _ratios(counts[0].astype(np.float64), counts[1].astype(np.float64) + counts[2], shares[1] + shares[2], smooth)


def _cut(df: DataFrame, key: Column, k: int) -> tuple[float, int, int]:
    """(the k-th largest key, rows of that key that are among the k, rows of that key). No sort: each round is a histogram
    inside the cell in which the one before had the cut, until one key is left. ``k``: from 1 to the number of rows."""
    rows = df.select(key.alias("key"))
    low, high, inside = rows.agg(F.min("key"), F.max("key"), F.count("*")).first()
    while low < high:
        width = (high - low) / 4096
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(4095)) if width > 0 else (F.col("key") > low).cast("int")
        cells = rows.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        for r in sorted(cells.collect(), key=lambda r: -r.a):
            if r.n >= k:
                low, high, inside = r.a, r.b, r.n
                break
            k -= r.n
    return low, k, inside


def top_k(df: DataFrame, key: str, k: int, place: str) -> DataFrame:
    """``df`` with ``selected``: the ``k`` largest of ``key``, exactly; ties by the least ``place``, a unique number of the row."""
    total = df.count()
    if k <= 0 or k >= total:
        return df.withColumn("selected", F.lit(k > 0))
    value, taken, tied = _cut(df, F.col(key), k)
    at_cut = F.col(key) == value
    if taken < tied:
        last, _, _ = _cut(df.where(at_cut), -F.col(place), taken)
        at_cut = at_cut & (-F.col(place) >= last)
    return df.withColumn("selected", (F.col(key) > value) | at_cut)


def importance_resample(df: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET) -> DataFrame:
    """(id_col, n_grams, log_ratio, key, kept): a share ``keep`` of all rows is drawn, or as many as expected.

    ``labels`` has the id, quality and toxic of some documents (0 or 1; null: unknown, not target). Null,
    empty and blank texts have no n-gram and the ratio ``NOTHING``. Equal texts have equal ratios, each id its own noise.
    Rows of equal id and text (null ids too) are tied, and drawn as rows of their own, as many as there is room for.
    An empty table gives an empty result. Other columns are ignored.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col(id_col).alias("id")).where("id is not null").distinct()
    good = least_hashed(good, unit_hash("id"), target, "id").withColumn("target", 1 + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(F.broadcast(good), "id", "left")
    shared = df.sparkSession.sparkContext.broadcast(log_ratios(marked, F.col("target")))
    scored = rows.mapInArrow(kernels.tidy(_scores(shared)), f"id {dict(rows.dtypes)['id']}, ratio double, n_grams long")
    unit = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    scored = scored.withColumn("key", F.col("ratio") - F.log(-F.log(unit))).withColumn("place", F.monotonically_increasing_id())
    scored = Scratch(df.sparkSession, "importance").stage(scored, "scores")
    n = scored.agg(F.count("*").alias("n"), F.sum(F.exp(F.least(F.lit(0.0), F.col("ratio")))).alias("expected")).first()
    out = top_k(scored, "key", round(n["n"] * keep) if keep is not None else round(n["expected"] or 0), "place")
    return out.select(F.col("id").alias(id_col), "n_grams", F.col("ratio").alias("log_ratio"), "key", F.col("selected").alias("kept"))
