"""The evaluation model over the star-schema tables: renderings of documents as parsers, probes derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_dir, kept

TYPES, LEVELS = ("factoid", "procedural", "tabular", "figural"), ("easy", "medium", "hard")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _text(system: str):
    t = F.col("text")
    return {"raw": t, "para": F.replace(t, F.lit("\n"), F.lit("\n\n")), "trunc": F.substring(t, F.lit(1), F.floor(F.length(t) * 6 / 10).cast("int")), "nolines": F.replace(t, F.lit("\n"), F.lit(" "))}[system]


def rendering(spark: SparkSession, sf_dir: str, system: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.lit(system).alias("system"), F.col("doc_id").alias("page_id"), _text(system).alias("markdown"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all cores, for work that is heavy beside a small file of one row group."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def spread_few(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all cores where their table has too few files for that."""
    return rows if len(rows.inputFiles()) >= rows.sparkSession.sparkContext.defaultParallelism else spread(rows, key)


def in_files(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in a file for each core at least, for work that is heavy and reads them several times: the table's own files where it has enough, else a copy."""
    if len(rows.inputFiles()) >= rows.sparkSession.sparkContext.defaultParallelism:
        return rows
    return kept(spread(rows, key), fresh_dir(rows.sparkSession, "dealt"))


def renderings(spark: SparkSession, sf_dir: str, *systems: str, dealt: bool = False, texts: DataFrame | None = None, probed: bool = False) -> DataFrame:
    """All renderings in one scan, of ``texts`` where they are given; ``dealt`` to all cores; ``probed`` with the page's question and answer."""
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), _text(s).alias("markdown")) for s in systems))).alias("r")
    texts = documents(spark, sf_dir).select("doc_id", "text") if texts is None else texts
    own = [c.alias(n) for n, c in _probed(F.col("text")).items()] if probed else []
    return (in_files(texts, "doc_id") if dealt else texts).select(F.col("doc_id").alias("page_id"), *own, rows).select("r.system", "page_id", *(_probed(F.col("text")) if probed else ()), "r.markdown")


def _probed(text: Column) -> dict[str, Column]:
    at = F.floor(F.length(text) / 3).cast("int") + 1
    return {"answer_span": F.substring(text, at, F.lit(30)), "question": F.substring(text, at, F.lit(60))}


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, own = F.col("doc_id"), _probed(F.col("text"))
    return documents(spark, sf_dir).select(
        i.alias("qa_id"), i.alias("page_id"), *(c.alias(n) for n, c in own.items()),
        F.element_at(F.array(*map(F.lit, TYPES)), (i % 4 + 1).cast("int")).alias("question_type"), F.element_at(F.array(*map(F.lit, LEVELS)), (i % 3 + 1).cast("int")).alias("difficulty"), "lang", "source",
    )


_SQL_TEXT = {"raw": "text", "para": "replace(text, chr(10), chr(10) || chr(10))", "trunc": "substr(text, 1, (length(text) * 6) // 10)", "nolines": "replace(text, chr(10), ' ')"}


def sql_renderings(*systems: str) -> str:
    return "pages_v AS (" + " UNION ALL ".join(f"SELECT '{s}' AS system, doc_id AS page_id, {_SQL_TEXT[s]} AS markdown FROM documents" for s in systems) + ")"


SQL_PROBE = (
    "qa_v AS (SELECT doc_id AS qa_id, doc_id AS page_id, substr(text, 1 + length(text) // 3, 30) AS answer_span, substr(text, 1 + length(text) // 3, 60) AS question, "
    "(['factoid','procedural','tabular','figural'])[CAST(doc_id % 4 + 1 AS INT)] AS question_type, (['easy','medium','hard'])[CAST(doc_id % 3 + 1 AS INT)] AS difficulty, lang, source FROM documents)"
)
SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_norm(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[|*#`>~_\s]', '', 'g')"


def sql_strip(x: str) -> str:
    return f"trim({x}, {SQL_SPACE})"


def sql_native(pages: str = "pages_v", least: int = 30) -> str:
    """chunks_v(system, page_id, pos, text): paragraphs, or the page where none is long enough."""
    return rf"""parts_v AS MATERIALIZED (SELECT system, page_id, {sql_strip('markdown')} AS whole, list_filter(list_transform(string_split_regex({sql_strip('markdown')}, '\n\s*\n+'), lambda p: {sql_strip('p')}), lambda p: length(p) >= {least}) AS parts FROM {pages}),
listed_v AS (SELECT system, page_id, CASE WHEN whole = '' THEN [] WHEN len(parts) > 0 THEN parts ELSE [whole] END AS parts FROM parts_v WHERE whole IS NOT NULL),
chunks_v AS MATERIALIZED (SELECT system, page_id, CAST(i - 1 AS INT) AS pos, parts[i] AS text FROM (SELECT system, page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM listed_v))"""
