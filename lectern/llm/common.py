"""What the operators of this package share: reading tables, the shared folder, staged tables, sets of ids, joins with hot keys."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import file_system, fresh_dir
from . import kernels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What holds while a step is written: rows can be long, so few bytes cross to Python at once; shuffle files go when the step has ended.
_STEP = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _step(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of rows that the driver has, through Arrow: from a list, Spark would start Python workers of another kind on the executors."""
    fields = [f.split() for f in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], _KINDS[kind]) for i, (name, kind) in enumerate(fields)}))


class Scratch:
    """Tables that steps of one call write into the shared folder and read back.

    This cuts the lineage in a place that survives the loss of executors. A table goes (``drop``) when what reads
    it has been written; the folder goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.n = spark, fresh_dir(spark, label), 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        with _step(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            store, p = file_system(self.spark, t._staged)
            store.delete(p, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """One staged table; it stays until the application ends."""
    return Scratch(df.sparkSession, label).stage(df, "rows")


#: Bits of a place that count rows of a file, and of those the ones inside a block: a block of places is a file of 128 KB.
_ROWS, _INSIDE = 39, 20


def located(df: DataFrame, *columns: Column, label: str = "rows") -> DataFrame:
    """``columns`` of a table and ``place``: in which file a row is (24 bits of a hash of its path), and which row of it.

    A table that is not read from files is written to the shared folder first, with these columns only.
    """
    try:
        if "_metadata" in df.columns:
            raise AnalysisException("its own column")
        own = df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        own.schema  # noqa: B018 - resolves
    except AnalysisException:
        own = staged(df.select(*columns), label).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    file = F.shiftleft(F.xxhash64("_file").bitwiseAND(F.lit((1 << 24) - 1)), _ROWS)
    return own.withColumn("place", file.bitwiseOR(F.col("_row"))).drop("_file", "_row")


def _write_blocks(folder: str):
    """Rows (block, place) in order of blocks: each block becomes a file of bits, written whole."""
    def run(batches):
        block, bits = None, None

        def written():
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base)
            part = f"{base}/{block}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(bits.tobytes())
            store.move(part, f"{base}/{block}.bits")
            return pa.record_batch([pa.array([block], pa.int64())], names=["block"])

        for batch in batches:
            blocks, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for one in np.unique(blocks).tolist():
                if one != block:
                    if block is not None:
                        yield written()
                    block, bits = one, np.zeros(1 << (_INSIDE - 3), np.uint8)
                at = places[blocks == one] & ((1 << _INSIDE) - 1)
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if block is not None:
            yield written()

    return run


def mark(scratch: Scratch, places: DataFrame) -> str:
    """A folder with the places of a table's only column as bits, a file for each block of rows of an input file.

    A scan opens the blocks of its own rows only (``marked``), so neither the driver nor a task has more of them, whatever their
    number, and no row moves to be chosen.
    """
    scratch.n += 1
    folder = f"{scratch.path}/bits-{scratch.n}"
    rows = places.toDF("place").select(F.shiftright("place", _INSIDE).alias("block"), "place").repartition("block").sortWithinPartitions("block")
    scratch.stage(rows.mapInArrow(kernels.tidy(_write_blocks(folder)), "block long"), "blocks")
    return folder


def marked(folder: str, places: np.ndarray) -> np.ndarray:
    """Whether places are among those of a folder that ``mark`` made (and those of a file whose path has the same 24 bits)."""
    store, base = kernels.held(("store", folder), lambda: fs.FileSystem.from_uri(folder))
    out, blocks = np.zeros(len(places), bool), places >> _INSIDE

    def read(block: int):
        try:
            with store.open_input_stream(f"{base}/{block}.bits") as f:
                return np.frombuffer(f.read(), np.uint8)
        except FileNotFoundError:
            return None

    for block in np.unique(blocks).tolist():
        last = kernels.held(("block", folder), dict)
        if block not in last:
            last.clear()
            last[block] = read(block)
        if last[block] is not None:
            own = np.flatnonzero(blocks == block)
            at = places[own] & ((1 << _INSIDE) - 1)
            out[own] = (last[block][at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
    return out


def unit_hash(*columns) -> Column:
    """A number in [0, 1) from the hash of columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def least_hashed(rows: DataFrame, hashed: Column, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of the least hash (a number in [0, 1)), ties by columns.

    Rows far above the cut that ``n`` of this many rows must have stay out of the ordering, so tasks send about twice ``n`` rows
    in all, not ``n`` each.
    """
    own = rows.withColumn("_h", hashed)
    total = own.count()
    below = own.where(F.col("_h") < min(1.0, (2 * n + 100) / max(total, 1)))
    if below.count() < min(n, total):  # repeated ids: few hashes for many rows
        below = own
    return below.orderBy("_h", *ties).limit(n).drop("_h")


#: A key is hot if it has more than LEAST_HOT rows and more than this part of all; so there are fewer hot keys than HOT.
HOT, LEAST_HOT = 50_000, 256


def _most(total: int) -> int:
    return max(LEAST_HOT, total // HOT)


def join_counts(rows: DataFrame, keys: list[str], table: DataFrame, count: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has each of ``keys`` once and beside it the number of rows that have it.

    The hot keys are broadcast (fewer than ``HOT``), so that no task gathers one. The others meet by an
    exchange. Keys are not null.
    """
    most = _most(table.agg(F.sum(count)).first()[0] or 0 if total is None else total)
    hot = table.where(F.col(count) > most).drop(count)
    cold = table.where(F.col(count) <= most).drop(count)
    spread = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return spread.unionByName(rows.join(F.broadcast(hot), keys))


def join_long_counts(rows: DataFrame, keys: list[str], table: DataFrame, count: str, total: int | None = None) -> DataFrame:
    """As ``join_counts``, where the first of ``keys`` is a long: one pass over ``rows``, whose plan is not copied for the hot keys.

    A row that met its hot key in the broadcast goes to the exchange by a hash of its own, and what it may meet there is not used.
    """
    most = _most(table.agg(F.sum(count)).first()[0] or 0 if total is None else total)
    names = [c for c in table.columns if c not in keys and c != count]
    own = F.struct(F.lit(True).alias("_there"), *names)
    hot = table.where(F.col(count) > most).select(*keys, own.alias("_hot"))
    cold = table.where(F.col(count) <= most).select(F.col(keys[0]).alias("_first"), *keys[1:], own.alias("_cold"))
    spread = F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*rows.columns))
    met = F.coalesce("_hot", "_cold")
    found = rows.join(F.broadcast(hot), keys, "left").withColumn("_first", spread).join(cold, ["_first", *keys[1:]], "left")
    return found.where(met.isNotNull()).select(*rows.columns, *(met[c].alias(c) for c in names))


def salted(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` joined with ``table`` (each ``key`` once), the rows of a hot key over several tasks.

    The number of tasks of each hot key is broadcast (fewer than ``HOT`` keys); its row of ``table`` is copied for each.
    """
    most = _most(rows.count())
    fans = rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_fan")).where("_fan > 1")
    names = [c for c in table.columns if c != key]
    fan = F.coalesce(F.col("_fan"), F.lit(1))
    wide = table.join(F.broadcast(fans), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
    own = rows.join(F.broadcast(fans), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), fan).cast("int")).drop("_fan")
    return own.join(wide, [key, "_salt"]).select(*rows.columns, *names)
