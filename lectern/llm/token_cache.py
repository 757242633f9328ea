"""Token counts through a digest cache.

The cache is a Parquet folder of (text_digest, tokenizer_digest, n_tokens). A text's digest is the
SHA-256 of its normalised content; the tokenizer's digest is that of its file and of this module's
rules, so a new version misses every old entry. Digests are joined to stored counts; only the distinct
texts that miss are encoded; their counts are appended. Texts do not cross an exchange.

Normalisation must not change a count: it is what the tokenizer itself does first, which for a byte-level
BPE is nothing, so content is the text itself (null as the empty text).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.utils import AnalysisException

from ..session import shared_dir
from . import kernels
from .common import Scratch, join_counts, located, mark, marked
from .tokens import encoder

RULES = "counts-1"
SCHEMA = "text_digest binary, tokenizer_digest string, n_tokens long"
#: Digests that a task remembers, so as not to encode one again.
SEEN = 1 << 20


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(RULES.encode() + f.read()).hexdigest()


def _counted(path: str, tokenizer: str, wanted):
    """Counts of rows (place, digest, text) whose place is marked, each digest once in a task."""
    def run(batches):
        enc = encoder(path)
        seen: set[bytes] = set()
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(marked(wanted, batch.column(0).to_numpy(zero_copy_only=False)))))
            keep = []
            for i, digest in enumerate(batch.column(1).to_pylist()):
                if digest not in seen:
                    keep.append(i)
                    if len(seen) < SEEN:
                        seen.add(digest)
            part = batch.take(pa.array(keep, pa.int64()))
            counts = [np.diff(offsets) for _, offsets in enc.batches(part.column(2))]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.record_batch([part.column(1), pa.array([tokenizer] * len(part), pa.string()), pa.array(n, pa.int64())], names=["text_digest", "tokenizer_digest", "n_tokens"])

    return run


def read_cache(spark, cache: str) -> DataFrame:
    """The stored counts; an empty table where there is no cache yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def compact(spark, cache: str, to: str) -> None:
    """Write the stored counts to a new folder, each once: appends leave a file or more for each run."""
    read_cache(spark, cache).groupBy("text_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens")).write.parquet(to)


def count_tokens(df: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row; what the cache lacks is encoded and appended to it.

    ``cache`` is a folder that executors share (default: one in ``spark.checkpoint.dir``). Only digests are exchanged: those
    that the cache lacks choose one row each by its place in its file, which is encoded where it is read, so texts stay in place, whatever
    their number. A null text counts as empty, with 0 tokens. Nothing is appended where nothing is lacking;
    two appends of one text by runs at the same time leave two equal rows, which are read as one. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "counts")
    cache = cache or f"{shared_dir(spark)}/token-counts"
    tokenizer = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = located(df, F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    each = scratch.stage(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", "place"), "digests")
    stored = lambda: read_cache(spark, cache).where(F.col("tokenizer_digest") == tokenizer).select(F.col("text_digest").alias("digest"), "n_tokens")
    distinct = scratch.stage(each.groupBy("digest").agg(F.count("*").alias("copies"), F.min("place").alias("place")), "distinct")
    lacking = scratch.stage(distinct.join(stored(), "digest", "left_anti").select("place", "digest"), "lacking")
    if not lacking.isEmpty():
        wanted = mark(scratch, lacking.select("place"))
        made = rows.select("place", "digest", "text").mapInArrow(kernels.tidy(_counted(path, tokenizer, wanted), keep=True), SCHEMA)
        made = scratch.stage(made, "made")
        new = made.dropDuplicates(["text_digest"]).join(lacking.select(F.col("digest").alias("text_digest")), "text_digest", "left_semi")
        new.write.mode("append").parquet(cache)
        scratch.drop(made)
    known = distinct.join(stored(), "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"), F.max("copies").alias("copies"))
    out = join_counts(each.drop("place"), ["digest"], known, "copies")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
