"""Integrity gates: each returns the offending rows or raises on the driver with their count."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import file_system


class GateError(ValueError):
    """An input or output that may not be used."""


def missing(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.join(present.select(key).distinct(), key, "left_anti")


def require_coverage(expected: DataFrame, present: DataFrame, key: str, label: str) -> None:
    """Every key of ``expected`` must be in ``present``; an empty text counts as present."""
    gone = missing(expected, present, key).agg(F.countDistinct(key).alias("keys"), F.count("*").alias("rows")).first()
    if gone["keys"]:
        n = expected.agg(F.countDistinct(key), F.count("*")).first()
        raise GateError(f"{label}: missing {gone['keys']}/{n[0]} evidence pages, affecting {gone['rows']}/{n[1]} Q-A")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    twice = rows.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise GateError(f"ambiguous {keys}: {[tuple(r[k] for k in keys) for r in twice]}")
    return rows


def require_counts(table: DataFrame, /, **expected: int) -> None:
    """``rows`` and distinct values of columns must be as many as expected; an expectation of None holds for any."""
    got = table.agg(*(F.expr(f"count({'distinct ' + c if c != 'rows' else '1'})").alias(c) for c in expected)).first()
    wrong = {c: (got[c], n) for c, n in expected.items() if n is not None and got[c] != n}
    if wrong:
        raise GateError(f"counts differ (got, expected): {wrong}")


def require_finite(rows: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.isnan(c) | (F.abs(c) == float("inf"))
    n = rows.where(bad).count()
    if n:
        raise GateError(f"{n} rows with NaN or infinity in {columns}")
    return rows


def differing(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str, tolerance: float = 0.0) -> DataFrame:
    """Rows that only one side has or whose values differ by more than the tolerance."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys), "full")
    return both.where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def require_same(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str, tolerance: float = 0.0) -> None:
    n = differing(a, b, keys, value, tolerance).count()
    if n:
        raise GateError(f"{n} rows differ in {value}")


def strict_mask(rows: DataFrame, excluded_domains: tuple[str, ...], excluded_ids: DataFrame, key: str = "qa_id", expected: int | None = None) -> DataFrame:
    """Rows of other domains whose id is not excluded; the count must be ``expected`` where given."""
    kept = rows.where(~F.col("domain").isin(*excluded_domains)).join(excluded_ids.select(key).distinct(), key, "left_anti")
    if expected is not None and kept.count() != expected:
        raise GateError(f"the mask keeps {kept.count()} rows, not {expected}")
    return kept


def require_output_name(path: str, marks: tuple[str, ...] = ("compat", "strict"), protected: tuple[str, ...] = ()) -> str:
    name = PurePosixPath(path).name
    if name in protected or not any(m in name for m in marks):
        raise GateError(f"{name} may not be written: a name must contain one of {marks} and not be protected")
    return path


def require_status(status: str, allowed: tuple[str, ...]) -> None:
    if status not in allowed:
        raise GateError(f"status {status!r} is none of {allowed}")


def require_files(spark: SparkSession, *paths: str) -> None:
    """Every path must be there, on whatever file system it names."""
    gone = [p for p in paths if not file_system(spark, p)[0].exists(file_system(spark, p)[1])]
    if gone:
        raise GateError(f"missing inputs: {gone}")


def require_cache_path(path: str, root: str) -> str:
    """A cache may only be written below its root, without a way out of it."""
    parts = PurePosixPath(path.split("://")[-1]).parts
    if ".." in parts or not path.rstrip("/").startswith(root.rstrip("/") + "/"):
        raise GateError(f"{path} is not below {root}")
    return path


def reconstruction_faults(cells: DataFrame, stored: DataFrame, by: tuple[str, ...], value: str, stored_value: str, tolerance: float = 1e-12) -> DataFrame:
    """(*by, reconstructed, stored) where the mean of a group's cells is not what is stored for it, or either is missing."""
    means = cells.groupBy(*by).agg(F.avg(value).alias("reconstructed"))
    both = means.join(stored.select(*by, F.col(stored_value).alias("stored")), list(by), "full")
    return both.where(F.col("reconstructed").isNull() | F.col("stored").isNull() | (F.abs(F.col("reconstructed") - F.col("stored")) > tolerance))


def partition_faults(parts: DataFrame, whole: DataFrame, key: str = "page_id", part: str = "fold") -> DataFrame:
    """(key, fault): keys in several parts (overlap), in none (uncovered), or not in the whole (unknown). parts(key, part) and whole(key)."""
    own = parts.groupBy(key).agg(F.countDistinct(part).alias("n"))
    both = own.join(whole.select(key).distinct().withColumn("_in", F.lit(True)), key, "full")
    fault = F.when(F.col("_in").isNull(), "unknown").when(F.col("n").isNull(), "uncovered").when(F.col("n") > 1, "overlap")
    return both.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def release_faults(manifest: DataFrame, stored: DataFrame, texts: DataFrame | None = None, local: tuple[str, ...] = ("/mnt/", "/home/")) -> DataFrame:
    """(path, fault) of a release: files that are missing or extra, whose hash or size is not the stored one, or (of
    texts(path, content)) that name a path of this machine. manifest and stored: (path, sha256, size)."""
    both = manifest.select("path", "sha256", "size").join(stored.select("path", F.col("sha256").alias("_sha"), F.col("size").alias("_size")), "path", "full")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("_sha").isNull(), "extra").when(F.col("sha256") != F.col("_sha"), "hash").when(F.col("size") != F.col("_size"), "size")
    out = both.select("path", fault.alias("fault")).where("fault IS NOT NULL")
    if texts is None:
        return out
    leaks = F.lit(False)
    for mark in local:
        leaks = leaks | F.contains("content", F.lit(mark))
    return out.unionByName(texts.where(leaks).select("path", F.lit("local path").alias("fault")))


def display_faults(rows: DataFrame, value: str, shown: str, digits: int = 2) -> DataFrame:
    """Rows whose shown string is not their value, computed again and rounded."""
    return rows.where(F.col(shown) != F.format_string(f"%.{digits}f", F.round(value, digits)))


def require_answers(rows: DataFrame, column: str = "pred", least: float = 0.9) -> DataFrame:
    """The share of rows that are not blank must reach ``least``: stubs are no answers."""
    share = rows.agg(F.avg((F.length(F.trim(F.coalesce(column, F.lit("")))) > 0).cast("double"))).first()[0]
    if share is not None and share < least:
        raise GateError(f"{share:.3f} of {column} has text, less than {least}")
    return rows


def finite(*columns: str) -> Column:
    """Whether all columns are numbers."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out


def mean_gap_gate(rows: DataFrame, value: str, threshold: float) -> bool:
    """Whether any value reaches the threshold."""
    return bool(rows.agg(F.coalesce(F.max(value) >= threshold, F.lit(False))).first()[0])
