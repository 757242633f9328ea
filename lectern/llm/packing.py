"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, by a merge tree.

1.  Texts become ids (and an end id). A longer document is cut into full pieces, its first piece
    taking the rest. The piece table (lengths, not ids) is written once.
2.  Each task packs its pieces best-fit, longest first, in runs of bounded size. Bins that are nearly
    full are done. Of the others every bin of at most half the capacity goes on (best-fit leaves one
    of a run at most, since any two fit together), and as many of the emptiest larger ones as can
    take part in a merge with them.
3.  The bins that go on are items of the next round, over an eighth of the tasks, until one run holds
    them all. Each round's table is written, so lost executors repeat a round at most.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernels
from .common import Scratch
from .tokens import encoder

CAPACITY = 2048
#: Free tokens up to which a bin counts as full.
SLACK = 8
#: Items that one best-fit run holds in memory.
RUN = 1 << 18
#: Larger underfull bins of a run that go on, for each small one. Any two small bins fit together, and a small one fits
#: with a larger one only if that has room for it, so what stays behind could have merged only with what a run has fewer than
#: one in SPARE of: at most as many sequences too many as small bins go on, one for each run of ``RUN`` items.
SPARE = 64
FAN_IN = 8


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin: best-fit, longest first; equal lengths in given order.

    ``open_`` has a bit for each free space that some bin has, so the best fit is its lowest set bit
    from the item's length on.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fills = 0, []
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        above = open_ >> size
        if above and size:
            space = size + (above & -above).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_ ^= 1 << space
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = space - size
        by_space[left].append(b)
        if left:
            open_ |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], np.int32)
        for batch in batches:
            row = 0
            for ids, offsets in enc.batches(batch.column(1)):
                out: list[tuple] = []
                for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    doc = np.concatenate([ids[a:b], end]).astype("<u4")
                    n = len(doc)
                    cut = n % capacity or capacity
                    for piece, (s, e) in enumerate(zip([0, *range(cut, n, capacity)], [*range(cut, n, capacity), n])):
                        out.append((row + d, piece, s, e - s, zlib.crc32(doc[s:e])))
                where, *columns = (pa.array(c) for c in zip(*out))
                row += len(offsets) - 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([batch.column(0).take(where), *(c.cast(k) for c, k in zip(columns, kinds))], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def _packed(capacity: int, last: bool):
    """Items with their bin of this round. A bin that goes on has ``goes`` set; its fill stands in all its rows."""
    def run(batches):
        made = TaskContext.get().partitionId() << 34

        def one(table: pa.Table):
            nonlocal made
            lengths = table.column("length").to_numpy()
            bins, offsets, fills = best_fit(lengths, capacity)
            under = np.flatnonzero(fills < capacity - SLACK)
            small = under[fills[under] * 2 <= capacity]
            large = under[fills[under] * 2 > capacity]
            large = large[np.argsort(fills[large], kind="stable")][: SPARE * max(1, len(small))]
            goes = np.zeros(len(fills), bool)
            if not last:
                goes[small] = goes[large] = True
            out = table.append_column("bin", pa.array(bins + made)).append_column("at", pa.array(offsets)).append_column("goes", pa.array(goes[bins])).append_column("fill", pa.array(fills[bins]))
            made += len(fills)
            return out.combine_chunks().to_batches()

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= RUN:
                yield from one(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from one(pa.Table.from_batches(held))

    return run


def tokenised_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row; a null text counts as empty and has its end id alone."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernels.tidy(_pieces(path, end_id, capacity), keep=True), f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long")


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a column ``length`` of 1 to ``capacity``) with sequence_id and offset.

    Items of the full length are sequences by themselves. Any other columns are kept. An empty table
    gives an empty result; a length outside the range raises an error.
    """
    whole = items.where(F.col("length") >= capacity)
    rest = items.where(F.col("length") < capacity)
    kind = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    extra = ", bin long, at long, goes boolean, fill long"
    tasks = max(1, rest.rdd.getNumPartitions())
    scratch = Scratch(items.sparkSession, "packing")
    level = scratch.stage(rest.mapInArrow(_packed(capacity, tasks == 1), kind(rest) + extra), "bins")
    rounds = []
    moved = None  # (bin, to, shift) of first-round bins that later rounds have put into others
    on = level.where("goes").groupBy("bin").agg(F.max("fill").alias("length"))
    n = 0
    while tasks > 1:
        n += 1
        tasks = -(-tasks // FAN_IN)
        here = on.withColumnRenamed("bin", "item").coalesce(tasks).mapInArrow(_packed(capacity, tasks == 1), "item long, length long" + extra)
        # Bins of later rounds get numbers of their own: the round in the bits below the task's.
        here = scratch.stage(here.select("item", (F.col("bin") + F.lit(n) * F.lit(1 << 58)).alias("bin"), "at", "goes", "fill"), "round")
        rounds.append(here)
        if moved is None:
            moved = here.select("item", "bin", "at")
        else:
            up = here.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("at").alias("shift"))
            moved = moved.join(up, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"))
        on = here.where("goes").groupBy("bin").agg(F.max("fill").alias("length"))
    names = items.columns
    done = level.select(*names, "bin", "at")
    if moved is not None:
        moved = scratch.stage(moved, "moved")
        scratch.drop(*rounds)
        up = moved.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("at").alias("shift"))
        done = level.where("goes").select(*names, "bin", "at").join(up, "bin", "left").select(*names, F.coalesce("to", "bin").alias("bin"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at")).unionByName(level.where("not goes").select(*names, "bin", "at"))
    packed = done.select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    alone = whole.select(*names, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Repeated rows are packed each for itself; rows with a null id too. Other columns are ignored.
    """
    pieces = Scratch(df.sparkSession, "packing").stage(tokenised_pieces(df, path, id_col, text_col, end_id, capacity), "pieces")
    return pack_items(pieces, capacity).withColumnRenamed("id", id_col)
