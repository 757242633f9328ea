"""Sinks: chunks, the per-query cube, strict JSON, reports, review sheets, manifests."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import once
from ..functions.text import escape_html
from ..operators.gates import GateError, require_finite
from ..session import file_system

#: Rows that one cell may gather: lines of a manifest, values of a cube. More raise an error.
GATHERED = 2_000_000


def _bounded(rows: DataFrame, what: str, most: int = GATHERED) -> DataFrame:
    n = rows.count()
    if n > most:
        raise GateError(f"{what} has {n} rows, more than the {most} that one document may gather")
    return rows


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select("chunk_id", "page_id", "text").write.mode("overwrite").json(path)


def cube_json(cube: DataFrame) -> DataFrame:
    """One row (value) with the cube as JSON: systems -> "<retriever>__<metric>@<k>" -> scores in the order of meta.qa_ids.

    A report of a probe's size (``GATHERED`` values, more raise); the long table is the form for more.
    """
    _bounded(cube, "the cube")
    cells = cube.groupBy("system", "retriever", "metric", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("qa_id", "value"))), lambda x: x["value"]).alias("v"))
    named = cells.groupBy("system").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("__", "retriever", F.concat_ws("@", "metric", F.col("k").cast("string"))).alias("key"), "v")))).alias("cells"))
    ids = cube.agg(F.array_sort(F.collect_set("qa_id")).alias("qa_ids"))
    return named.agg(F.map_from_entries(F.collect_list(F.struct("system", "cells"))).alias("systems")).crossJoin(ids).select(F.to_json(F.struct(F.struct("qa_ids").alias("meta"), "systems")).alias("value"))


def write_strict_json(rows: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinity raise before anything is written."""
    numbers = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "float")]
    (require_finite(rows, *numbers) if numbers else rows).write.mode("overwrite").json(path)


def report_json(report: dict) -> str:
    """A report as JSON for people; NaN and infinity raise."""
    return json.dumps(report, allow_nan=False, ensure_ascii=False, indent=2)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file on any file system that Spark reaches: under another name first, then renamed over the old one,
    so a reader sees the old text or the whole new one."""
    fs, target = file_system(spark, path)
    _, draft = file_system(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(draft, target):  # some file systems do not rename over a file
        fs.delete(target, False)
        if not fs.rename(draft, target):
            raise OSError(f"cannot rename to {path}")


def markdown_table(rows: DataFrame, limit: int = 1000, digits: int = 4) -> str:
    """A report table of ``limit`` rows at most; more raise."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise GateError(f"a report table has more than {limit} rows")
    lines = [rows.columns, ["---"] * len(rows.columns), *([show(v) for v in r] for r in got)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def coverage_report(rates: DataFrame) -> str:
    """The coverage table of a report: a system's rates in percent, best first."""
    percent = lambda c: F.format_string("%.1f %%", F.round(100 * F.col(c), 1))
    return markdown_table(rates.orderBy(F.desc("coverage"), "system").select("system", "total", *(percent(c).alias(c) for c in ("coverage", "split_rate", "parser_fault"))))


def ladder_report(rates: DataFrame, reference: str) -> str:
    """Absent rates by rung, a system a row, with the gap to a reference system in points: rates(system, rung, absent)."""
    rungs = [r.rung for r in rates.select("rung").distinct().orderBy("rung").limit(20).collect()]
    wide = rates.groupBy("system").pivot("rung", rungs).agg(F.first("absent"))
    ref = wide.where(F.col("system") == reference).select(*(F.col(f"`{r}`").alias(f"ref_{r}") for r in rungs))
    cell = lambda r: F.format_string("%.1f (%+.1f)", F.round(100 * F.col(f"`{r}`"), 1), F.round(100 * (F.col(f"`{r}`") - F.col(f"`ref_{r}`")), 1))
    return markdown_table(wide.crossJoin(F.broadcast(ref)).orderBy("system").select("system", *(cell(r).alias(r) for r in rungs)))  # one row beside each


def review_sheet(rows: DataFrame, title: str, fields: tuple[str, ...], image: str | None = None) -> DataFrame:
    """(slot, value): HTML fragments of a review sheet, one row each; an image column (binary) is embedded."""
    parts: list[Column] = [F.concat(F.lit(f"<dt>{f}</dt><dd>"), escape_html(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit("</dd>")) for f in fields]
    if image:
        parts.append(F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(image), F.lit('">')))
    return rows.select("slot", F.concat(F.lit(f"<section><h2>{title} "), F.col("slot").cast("string"), F.lit("</h2><dl>"), *parts, F.lit("</dl></section>")).alias("value"))


def manifest(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sha256, size) of contents; strings count as UTF-8."""
    return rows.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"))


def manifest_digest(rows: DataFrame, path: str = "path") -> DataFrame:
    """(digest, n): one hash over the sorted lines '<sha256>  <path>' of a manifest. Lines, not contents, meet, and
    ``GATHERED`` of them at most; ``manifest_tree`` has no bound."""
    _bounded(rows, "the manifest")
    line = F.concat_ws("  ", "sha256", F.col(path).cast("string"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).cast("string").alias("p"), line.alias("line")))), lambda x: x["line"]), "\n").cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


def manifest_tree(rows: DataFrame, path: str = "path", digits: int = 3) -> DataFrame:
    """(digest, n): a hash over the hashes of 16^digits parts of a manifest, each over its own sorted lines. Parts are dealt by
    the hash of the path, so each has its share of the lines, however many there are."""
    name = F.col(path).cast("string")
    line = F.struct(name.alias("p"), F.concat_ws("  ", "sha256", name).alias("line"))
    parts = rows.select(F.substring(F.sha2(name.cast("binary"), 256), 1, digits).alias("part"), line.alias("x")).groupBy("part")
    parts = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").cast("binary"), 256).alias("h"), F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: F.concat_ws("  ", x["h"], x["part"]))
    return parts.agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest"), F.sum("n").alias("n"))


def _prefixed(value: Column) -> Column:
    """Hex of a string's UTF-8 after its length in 8 bytes."""
    return once(value.cast("binary"), lambda b: F.concat(F.lpad(F.hex(F.octet_length(b)), 16, "0"), F.hex(b)))


def _sha_of_hex(parts: Column) -> Column:
    return F.sha2(F.unhex(F.array_join(parts, "")), 256)


def tree_digest(rows: DataFrame, by: tuple[str, ...] = (), path: str = "path", content: str = "content", most: int = 1 << 28) -> DataFrame:
    """(*by, digest): SHA-256 over the files of a tree in the order of their paths: length and path, then the content.

    Contents of a tree meet in one cell, ``most`` bytes of them at most; a larger tree raises.
    """
    body = F.col(content).cast("binary")
    size = rows.groupBy(*by).agg(F.sum(F.octet_length(body)).alias("n")).agg(F.max("n")).first()[0] or 0
    if size > most:
        raise GateError(f"a tree has {size} bytes, more than {most}")
    one = F.struct(F.col(path).cast("string").alias("p"), F.concat(_prefixed(F.col(path).cast("string")), F.hex(body)).alias("x"))
    return rows.groupBy(*by).agg(_sha_of_hex(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["x"])).alias("digest"))


def boundary_digest(boundaries: DataFrame, by: tuple[str, ...] = ("page_id",), key: str = "key", prev: str = "prev_text", nxt: str = "next_text", order: str = "pos") -> DataFrame:
    """(*by, digest, n): SHA-256 over key and both texts of each boundary, all with their lengths, in scoring order."""
    one = F.struct(F.col(order).alias("o"), F.concat(*(_prefixed(F.col(c).cast("string")) for c in (key, prev, nxt))).alias("x"))
    return boundaries.groupBy(*by).agg(_sha_of_hex(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["x"])).alias("digest"), F.count("*").alias("n"))


def canonical_digest(payload) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
