"""Scans: Q-A records, page texts, training rows, benchmark rows, chunks, embeddings, scores."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import page_key, row_key
from ..operators.gates import GateError, require_coverage, require_unique
from ..session import file_system
from . import page_files

QA_SCHEMA = (
    "qa_id string, page_id string, doc_id string, language string, domain string, question string, answer_span string, answer_chunk string, question_type string, difficulty string, "
    "multi_page boolean, referenced_pages array<string>, metadata struct<generator_model:string,generator_temperature:double,generation_timestamp:string,human_verified:boolean,verification_notes:string,rationale:string>"
)


def _decoded(path) -> Column:
    """A file's path without the escapes of a URI; a plus is a plus."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


MESSAGES = "messages array<struct<role:string,content:string>>, images array<string>"
CHUNKS = "chunk_id string, page_id string, text string"
PREFERENCE = "page_id string, image string, system_prompt string, user_prompt string, chosen_markdown string, rejected_markdown string, chosen_rcps double, rejected_rcps double, rcps_gap double, n_qa int"
QUESTION_TYPES, DIFFICULTIES = ("factoid", "procedural", "tabular", "figural"), ("easy", "medium", "hard")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Q-A records of JSON lines; blank lines are skipped, ``multi_page`` and ``referenced_pages`` have defaults."""
    rows = spark.read.schema(QA_SCHEMA).json(path)
    return rows.withColumns({"multi_page": F.coalesce("multi_page", F.lit(False)), "referenced_pages": F.coalesce("referenced_pages", F.array().cast("array<string>"))})


def invalid_enums(qa: DataFrame) -> DataFrame:
    return qa.where(~F.col("question_type").isin(*QUESTION_TYPES) | ~F.col("difficulty").isin(*DIFFICULTIES))


def numbered_lines(spark: SparkSession, path: str, keep_blank_numbers: bool = True) -> DataFrame:
    """(index, value): lines of a file with their number from 0. Blank lines go, but take a number if ``keep_blank_numbers``.

    Line order is what Spark's own line reader gives; numbering takes one pass for the counts of partitions. A folder's files
    (``page_files.numbered``) are in the order of their names.
    """
    fs, p = file_system(spark, path)
    if keep_blank_numbers and fs.isDirectory(p):
        return page_files.numbered(spark, path)
    lines = spark.read.text(path)
    kept = lines if keep_blank_numbers else lines.where(F.trim("value") != "")
    rows = kept.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    return spark.createDataFrame(rows, "index long, value string").where(F.trim("value") != "")


def page_index(spark: SparkSession, path: str, prefix: str = "val") -> DataFrame:
    """(page_id, stem): the n-th line's key, and <doc>_<page> of its first image."""
    from ..functions.text import doc_page

    rows = numbered_lines(spark, path).withColumn("r", F.from_json("value", MESSAGES))
    return rows.select(row_key(F.col("index"), prefix).alias("page_id"), doc_page(F.get("r.images", F.lit(0))).alias("stem"))


def ground_truth(spark: SparkSession, path: str, prefix: str = "val", pages: DataFrame | None = None) -> DataFrame:
    """(page_id, markdown): the first assistant message of each line, of the given pages only."""
    rows = numbered_lines(spark, path).withColumn("r", F.from_json("value", MESSAGES))
    out = rows.select(row_key(F.col("index"), prefix).alias("page_id"), assistant_message(F.col("r.messages")).alias("markdown"))
    return out if pages is None else out.join(pages.select("page_id").distinct(), "page_id", "left_semi")


def assistant_message(messages):
    return F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"]


def _arrow_reads(folder: str, recursive: bool = False) -> bool:
    """Whether tasks can list and open the files themselves; stores that only Spark reads, and other patterns of folders, go by Spark's file source."""
    if set("*?[{") & set(folder if recursive else folder.removesuffix("/*")):
        return False
    try:
        return page_files.reaches(folder)
    except (ValueError, NotImplementedError, OSError):
        return False


def _files(spark: SparkSession, folder: str, pattern: str = "*.md") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(rows with stem and path of the files, what adds their texts as ``markdown``): so that names meet other rows before any file is opened."""
    if _arrow_reads(folder):
        return page_files.listed(spark, folder, pattern).select("stem", "path"), lambda rows: page_files.opened(rows, folder)
    return read_markdown(spark, folder, pattern), lambda rows: rows


def read_markdown(spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """(stem, path, markdown) of every file, in no order. An empty file is an empty text. ``page_files.read_files`` opens only files that filters choose."""
    if _arrow_reads(folder, recursive):
        return page_files.opened(page_files.listed(spark, folder, pattern, recursive).select("stem", "path"), folder)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    files = reader.load(folder)
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    # File sources leave out empty files, so the listing that the driver has anyway says which there are.
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(bare(_decoded(F.col("path"))).alias("path"))
    read = files.select(bare("path").alias("path"), F.decode("content", "UTF-8").alias("markdown"))
    name = F.substring_index(F.col("path"), "/", -1)
    return listed.join(read, "path", "left").select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "path", F.coalesce("markdown", F.lit("")).alias("markdown"))


def parsed_pages(spark: SparkSession, root: str, allowed: DataFrame | None = None) -> DataFrame:
    """(page_id, markdown) of ``<root>/<part>/<page_id>.md``; of the allowed pages only. Two files of one page raise."""
    files, with_texts = _files(spark, f"{root}/*")
    files = files.withColumnRenamed("stem", "page_id")
    files = files if allowed is None else files.join(allowed.select("page_id").distinct(), "page_id", "left_semi")
    require_unique(files.select("page_id"), "page_id")
    return with_texts(files).select("page_id", "markdown")


def parser_output(spark: SparkSession, folder: str, index: DataFrame, parser: str, strict: bool = False) -> DataFrame:
    """(parser, page_id, markdown) of the pages of an index that have a file; ``strict`` raises where any has none."""
    files, with_texts = _files(spark, folder)
    if strict:
        gone = index.join(files, "stem", "left_anti").count()
        if gone:
            raise GateError(f"{parser}: {gone} pages have no file")
    return with_texts(index.join(files, "stem").select("page_id", *files.columns)).select(F.lit(parser).alias("parser"), "page_id", "markdown")


def document_index(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(name, path) of all files below a folder, listed in tasks where they can; two files of one name raise."""
    if _arrow_reads(root, True):
        store = re.match("[a-z0-9]+://[^/]*", root)
        files = page_files.below(spark, root, f"*{suffix}").select(F.concat(F.lit(store[0] if store else "file://"), "path").alias("path"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).inputFiles()
        files = spark.createDataFrame([(f,) for f in files], "path string").select(_decoded(F.col("path")).alias("path"))
    return require_unique(files.select(F.regexp_replace(F.substring_index("path", "/", -1), rf"{suffix.replace('.', '[.]')}$", "").alias("name"), "path"), "name")


def resolve(index: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of logical names (column ``name``, whose last path part is looked up)."""
    asked = names.select(F.col("name").alias("asked"), F.substring_index("name", "/", -1).alias("name")).distinct()
    return asked.join(index, "name"), asked.join(index, "name", "left_anti")


def flat_questions(rows: DataFrame, domains: Iterable[str] | None = None) -> DataFrame:
    """Q-A rows of page rows whose struct ``qas`` has parallel arrays."""
    fields = ("ID", "questions", "answers", "doc_name", "evidence_page_no", "doc_type")
    zipped = F.arrays_zip(*(F.col(f"qas.{f}").alias(f) for f in fields))
    out = rows.select("domain", F.inline(zipped)).select(
        F.col("ID").alias("qa_id"), page_key(F.col("doc_name"), F.col("evidence_page_no")).alias("page_id"), F.col("doc_name").alias("doc_id"),
        "domain", F.col("doc_type").alias("declared_domain"), F.col("questions").alias("question"), F.col("answers").alias("answer_span"),
    )
    return out if domains is None else out.where(F.col("domain").isin(*domains))


def audited_questions(rows: DataFrame, pages: DataFrame, domains: Iterable[str] | None = None) -> DataFrame:
    """Q-A rows whose declared domain is their page row's, and whose evidence page is in the corpus; others raise."""
    qa = flat_questions(rows, domains)
    wrong = qa.where(F.col("domain") != F.col("declared_domain")).count()
    if wrong:
        raise GateError(f"{wrong} Q-A rows declare another domain than their page row")
    require_coverage(qa, pages, "page_id", "corpus")
    return qa


def corpus_page_ids(spark: SparkSession, path: str, without: Iterable[str] = ()) -> DataFrame:
    """Distinct page keys of benchmark rows; only two columns are read."""
    return spark.read.parquet(path).select(page_key(F.col("doc_name"), F.col("page_idx")).alias("page_id")).where(~F.col("page_id").isin(*without)).distinct()


def read_page_json(spark: SparkSession, folder: str, expected: DataFrame | None = None) -> DataFrame:
    """(page_id, markdown) of one JSON array of (page_idx, text) for each document; a null text of a page becomes ''."""
    rows = spark.read.schema("page_idx int, text string").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    name = F.regexp_replace(F.substring_index(_decoded(F.col("_metadata.file_path")), "/", -1), r"\.json$", "")
    out = rows.select(page_key(name, F.col("page_idx")).alias("page_id"), F.coalesce("text", F.lit("")).alias("markdown"))
    return out if expected is None else out.join(expected.select("page_id"), "page_id", "left_semi")


def read_chunks(spark: SparkSession, path: str, pages: DataFrame | None = None) -> DataFrame:
    """Stored chunks with their place in the page, of the given pages only."""
    rows = spark.read.schema(CHUNKS).json(path).withColumn("pos", F.substring_index("chunk_id", "#", -1).cast("int"))
    return rows if pages is None else rows.join(pages.select("page_id"), "page_id", "left_semi")


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFERENCE).json(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """(system, retriever, metric, k, qa_id, value) of a JSON file of arrays in the order of ``meta.qa_ids``."""
    text = spark.read.option("wholetext", True).text(path)
    body = text.select(F.from_json("value", "meta struct<qa_ids:array<string>>, systems map<string,map<string,array<double>>>").alias("r"))
    rows = body.select("r.meta.qa_ids", F.explode("r.systems").alias("system", "cells")).select("qa_ids", "system", F.explode("cells").alias("cell", "scores"))
    rows = rows.select("system", "cell", F.inline(F.arrays_zip(F.col("qa_ids").alias("qa_id"), F.col("scores").alias("value"))))
    key = rows.withColumn("retriever", F.regexp_replace("cell", "__[^_]*$", "")).withColumn("tail", F.regexp_extract("cell", "__([^_]*)$", 1))
    return key.select("system", "retriever", F.regexp_extract("tail", "^([a-z]+)@", 1).alias("metric"), F.regexp_extract("tail", "@([0-9]+)$", 1).cast("int").alias("k"), "qa_id", "value")


def parse_metric_key(key):
    """STRUCT(metric, k, retriever) of ``hit@5__dense``."""
    return F.struct(F.regexp_extract(key, "^([a-z]+)@", 1).alias("metric"), F.regexp_extract(key, "@([0-9]+)__", 1).cast("int").alias("k"), F.regexp_extract(key, "__(.*)$", 1).alias("retriever"))


def training_examples(qa: DataFrame, pages: DataFrame, fold: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(examples, counts of what was left out): Q-A of a fold with the page's text and image.

    Q-A without a page, and pages without an image (a null), are left out and counted.
    """
    own = qa if fold is None else qa.join(fold.select("page_id"), "page_id", "left_semi")
    joined = own.join(pages, "page_id")
    kept = joined.where(F.col("image").isNotNull())
    return kept, {"no_page": own.join(pages, "page_id", "left_anti").count(), "no_image": joined.where(F.col("image").isNull()).count()}


def read_config(path: str) -> dict:
    """A JSON configuration, or YAML where that library is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)
