"""Incremental work: fingerprinted, append-only results keyed by input, on batches and on file streams."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.gates import GateError
from ..operators.prefer import keep_last
from ..session import file_system
from ..sources.sinks import canonical_digest
from .commits import CommitLog


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bind(spark: SparkSession, store: str, fingerprint: dict) -> None:
    """Tie a store to its inputs and settings. A store of another fingerprint, or of results without one, is refused."""
    digest = canonical_digest(fingerprint)
    known = [r.digest for r in _read(spark, f"{store}/fingerprint", "digest string").collect()]
    if known and set(known) != {digest}:
        raise GateError("the store was made with other inputs or settings")
    if not known:
        if CommitLog(spark, f"{store}/results", "key string").commits():
            raise GateError("the store has results but no fingerprint")
        spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.parquet(f"{store}/fingerprint")


def score_pending(rows: DataFrame, store: str, key: str, score: Callable[[DataFrame], DataFrame], schema: str, order: str = "seq") -> DataFrame:
    """Score the rows whose key the store lacks, append them, and return all results, the last of each key.

    Rows that ``score`` gives with a null ``value`` stay pending: nothing is stored for them. Results are one commit of the store's
    log: a run that dies stores nothing, and two runs at once store both, of which the last of each key is read.
    """
    log = CommitLog(rows.sparkSession, f"{store}/results", schema)
    pending = rows.join(log.read().select(key).distinct(), key, "left_anti")
    log.append(score(pending).where(F.col("value").isNotNull()))
    return keep_last(log.read(), (key,), order)


def save_vectors(vectors: DataFrame, store: str, fingerprint: dict) -> None:
    """Keep encoded rows under the settings that made them; a store of other settings is refused."""
    bind(vectors.sparkSession, store, fingerprint)
    CommitLog(vectors.sparkSession, f"{store}/results", vectors.schema).append(vectors, {"schema": vectors.schema.json()})


def load_vectors(spark: SparkSession, store: str, fingerprint: dict, keys: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """The vectors of a store that was made with these settings, of the given keys only; keys that it lacks raise."""
    bind(spark, store, fingerprint)
    log = CommitLog(spark, f"{store}/results", "")
    if not (commits := log.commits()):
        raise GateError("the store has no vectors")
    log.schema = T.StructType.fromJson(json.loads(commits[-1].note["schema"]))
    got = log.read()
    if keys is None:
        return got
    gone = keys.select(key).distinct().join(got, key, "left_anti").count()
    if gone:
        raise GateError(f"{gone} keys have no vector")
    return got.join(keys.select(key).distinct(), key, "left_semi")


def read_json_checkpoint(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines whose cut-off last line is dropped; the last of each key stays."""
    return keep_last(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), (key,), order)


def wait_for(spark: SparkSession, path: str, files: int = 1, minutes: float = 240.0, every: float = 60.0) -> int:
    """Wait until a path (a pattern may be used) has ``files`` files on its file system; how many there are. Raises when time is up."""
    until = time.monotonic() + 60 * minutes
    fs, p = file_system(spark, path)
    while True:
        found = fs.globStatus(p)
        n = len(found) if found else 0
        if n >= files:
            return n
        if time.monotonic() >= until:
            raise GateError(f"{n} of {files} files at {path} after {minutes} minutes")
        time.sleep(min(every, max(0.0, until - time.monotonic())))


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all files that are there, batch by batch, exactly once by the checkpoint, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def file_stream(spark: SparkSession, path: str, schema, files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_mean(rows: DataFrame, value: str):
    """(rows with observed metrics, observation): count and mean while a job runs, no second pass."""
    from pyspark.sql import Observation

    seen = Observation("progress")
    return rows.observe(seen, F.count("*").alias("n"), F.avg(value).alias("mean")), seen
