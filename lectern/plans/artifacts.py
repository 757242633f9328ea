"""Queries of files and stored results: scans, replays, gates, digests, judging, report values."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import statistics as st, text as tx, vectors as vx
from ..operators import chunk, gates, judge, metrics, prefer, retrieve
from ..session import fresh_dir, kept
from ..sources import corpus, page_files, sinks
from ..streaming import incremental
from .registry import query
from .retrieval import _DENSE, _dense_cube
from .statistics import _CUBE, _PAIR, _cube, _paired
from .views import SQL_PROBE, documents, probe, read, rendering, renderings, spread, sql_native, sql_renderings


def _pages(spark, sf_dir) -> DataFrame:
    """The documents as pages: number, name, text. Ids are numbers from 0."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("k"), "source", F.coalesce("text", F.lit("")).alias("text"))


_STEM = "'doc' || k % 4 || '_page_' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INT), '0')"
_LINE = "'val_' || lpad(CAST(k + k // 5 AS VARCHAR), CAST(greatest(4, length(CAST(k + k // 5 AS VARCHAR))) AS INT), '0')"
_PAGES = "WITH p AS (SELECT doc_id AS k, source, coalesce(text, '') AS text FROM documents) "


def _stem() -> Column:
    k = F.col("k").cast("string")
    return F.concat(F.lit("doc"), (F.col("k") % 4).cast("string"), F.lit("_page_"), F.lpad(k, F.greatest(F.length(k), F.lit(4)), F.lit("0")))


#: Pages of one file of lines.
_LINES = 500


def _val_file(spark, sf_dir, base: str) -> str:
    """A training file in parts: a JSON line for each page, whose first image names its document; a blank line after every fifth takes a number too."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    image = F.concat(F.lit("/data/images/documents/doc"), (F.col("k") % 4).cast("string"), F.lit("/"), F.regexp_extract(_stem(), "page_.*", 0), F.lit(".png"))
    line = F.to_json(F.struct(F.array(turn("user", F.lit("read this")), turn("assistant", F.concat(F.lit("# "), F.col("text")))).alias("messages"), F.array(image).alias("images")))
    line = F.concat(line, F.when(F.col("k") % 5 == 4, "\n\n").otherwise("\n"))
    files = _pages(spark, sf_dir).select("k", F.floor(F.col("k") / _LINES).alias("file"), line.alias("line")).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("lines"))
    name = F.concat(F.lpad(F.col("file").cast("string"), 8, "0"), F.lit(".jsonl"))
    page_files.write_files(files.select(name.alias("path"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("content")), f"{base}/val")
    return f"{base}/val"


@query(_PAGES + f"SELECT 'p' AS parser, {_LINE} AS page_id, CASE WHEN k % 6 = 0 THEN '' ELSE text END AS markdown FROM p WHERE k % 7 <> 0")
def markdown_scan(spark, sf_dir):
    """A folder of Markdown files, some of them empty, joined to the numbered pages of a training file."""
    base = fresh_dir(spark, "markdown")
    own = _pages(spark, sf_dir).where("k % 7 <> 0")
    page_files.write_files(own.select(F.concat(_stem(), F.lit(".md")).alias("path"), F.when(F.col("k") % 6 == 0, "").otherwise(F.col("text")).alias("content")), f"{base}/md")
    return corpus.parser_output(spark, f"{base}/md", corpus.page_index(spark, _val_file(spark, sf_dir, base)), "p")


@query(_PAGES + "SELECT 'page_' || k AS page_id, text AS markdown FROM p WHERE source <> 'src2'")
def parsed_pages(spark, sf_dir):
    """Files in parts of a folder, of the allowed pages only."""
    base = fresh_dir(spark, "parts")
    page_id = F.concat(F.lit("page_"), F.col("k").cast("string"))
    pages = _pages(spark, sf_dir)
    page_files.write_files(pages.select(F.concat("source", F.lit("/"), page_id, F.lit(".md")).alias("path"), F.col("text").alias("content")), base)
    return corpus.parsed_pages(spark, base, pages.where("source <> 'src2'").select(page_id.alias("page_id")))


@query(_PAGES + "SELECT source AS part, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS size FROM p WHERE source IN ('src1', 'src2', 'src5') GROUP BY source")
def page_files_of_parts(spark, sf_dir):
    """The source of text files with a filter that chooses folders before any file is opened."""
    base = fresh_dir(spark, "files")
    page_files.write_files(_pages(spark, sf_dir).select(F.concat("source", F.lit("/"), _stem(), F.lit(".md")).alias("path"), F.col("text").alias("content")), base)
    rows = page_files.read_files(spark, base, ".md").where(F.col("part").isin("src1", "src2", "src5"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("SELECT 'docs/d' || doc_id || CASE WHEN doc_id % 8 = 0 THEN '-gone' ELSE '' END AS asked, doc_id % 8 <> 0 AS found FROM documents")
def document_resolve(spark, sf_dir):
    """Logical names looked up among all files below a folder."""
    base = fresh_dir(spark, "documents")
    name = F.concat(F.lit("d"), F.col("k").cast("string"))
    pages = _pages(spark, sf_dir)
    page_files.write_files(pages.select(F.concat("source", F.lit("/"), name, F.lit(".pdf")).alias("path"), F.col("text").alias("content")), base)
    names = pages.select(F.concat(F.lit("docs/"), name, F.when(F.col("k") % 8 == 0, "-gone").otherwise("")).alias("name"))
    found, missing = corpus.resolve(corpus.document_index(spark, base, ".pdf"), names)
    return found.select("asked", F.lit(True).alias("found")).unionByName(missing.select("asked", F.lit(False).alias("found")))


@query(_PAGES + f"SELECT {_LINE} AS page_id, {_STEM} AS stem, '# ' || text AS markdown FROM p WHERE k % 3 = 0")
def page_numbers(spark, sf_dir):
    """Keys by line number and the true text of each page, of a set of pages."""
    path = _val_file(spark, sf_dir, fresh_dir(spark, "lines"))
    index = corpus.page_index(spark, path)
    wanted = index.where((F.substring_index("stem", "_", -1).cast("int") % 3) == 0)
    return wanted.join(corpus.ground_truth(spark, path, pages=wanted), "page_id")


@query(_PAGES + "SELECT source || '-' || k // 40 || '__p' || k AS page_id, CASE WHEN k % 5 = 0 THEN '' ELSE text END AS markdown FROM p WHERE k % 40 <> 7")
def page_json(spark, sf_dir):
    """One JSON array of pages for each document (here up to 40 texts of a source), of the expected pages."""
    base = fresh_dir(spark, "pages")
    name = F.concat("source", F.lit("-"), F.floor(F.col("k") / 40).cast("string"))
    page = F.struct(F.col("k").alias("page_idx"), F.when(F.col("k") % 5 != 0, F.col("text")).alias("text"))
    pages = _pages(spark, sf_dir).withColumn("name", name)
    whole = pages.groupBy("name").agg(F.to_json(F.collect_list(page)).alias("content"))
    page_files.write_files(whole.select(F.concat("name", F.lit(".json")).alias("path"), "content"), base)
    return corpus.read_page_json(spark, base, pages.where("k % 40 <> 7").select(F.concat("name", F.lit("__p"), F.col("k").cast("string")).alias("page_id")))


@query(f"WITH {SQL_PROBE} SELECT CAST(qa_id AS VARCHAR) AS qa_id, question_type, difficulty, FALSE AS multi_page, 0 AS n_refs, answer_span FROM qa_v")
def qa_records(spark, sf_dir):
    """The probe as JSON lines, read as typed records: what a line lacks has its default."""
    base = fresh_dir(spark, "qa")
    rows = probe(spark, sf_dir).select(F.col("qa_id").cast("string").alias("qa_id"), F.col("page_id").cast("string").alias("page_id"), "question", "answer_span", "question_type", "difficulty")
    rows.write.json(base)
    qa = corpus.read_qa(spark, base)
    return qa.select("qa_id", "question_type", "difficulty", "multi_page", F.size("referenced_pages").alias("n_refs"), "answer_span")


@query("SELECT o_orderkey || '-' || l_linenumber AS qa_id, 'c' || o_custkey || '__p' || l_linenumber AS page_id, o_orderpriority AS domain, CAST(l_quantity AS VARCHAR) AS question FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'")
def benchmark_rows(spark, sf_dir):
    """Page rows with parallel arrays of questions, flattened and filtered by domain; evidence pages are all in the corpus."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("l"))
    rows = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    each = lambda f: F.transform("l", f)
    doc = F.concat(F.lit("x/c"), F.col("o_custkey").cast("string"))
    qas = F.struct(
        each(lambda x: F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), x["l_linenumber"].cast("string"))).alias("ID"), each(lambda x: x["l_quantity"].cast("string")).alias("questions"), each(lambda x: F.lit("a")).alias("answers"),
        each(lambda x: doc).alias("doc_name"), each(lambda x: x["l_linenumber"]).alias("evidence_page_no"), each(lambda x: F.col("o_orderpriority")).alias("doc_type"),
    )
    rows = rows.select(F.col("o_orderpriority").alias("domain"), qas.alias("qas"))
    domains = [r[0] for r in read(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect() if r[0] != "5-LOW"]
    base = fresh_dir(spark, "corpus")
    read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(doc.alias("doc_name"), F.col("l_linenumber").alias("page_idx")).write.parquet(base)
    qa = corpus.audited_questions(rows, corpus.corpus_page_ids(spark, base), domains)
    return qa.select("qa_id", "page_id", "domain", "question")


@query(f"WITH {SQL_PROBE}, f AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT qa_id, length(text) AS n_chars FROM qa_v JOIN documents d ON d.doc_id = page_id WHERE page_id IN (SELECT doc_id FROM f) AND page_id % 10 <> 0 AND page_id % 4 <> 0")
def training_fold(spark, sf_dir):
    """Questions of a fold with their pages; pages that are missing or have no image are left out."""
    pages = documents(spark, sf_dir).where("doc_id % 10 <> 0").select(F.col("doc_id").alias("page_id"), "text", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("/images/"), F.col("doc_id").cast("string"))).alias("image"))
    fold = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id")).distinct()
    rows, _ = corpus.training_examples(probe(spark, sf_dir).select("qa_id", "page_id"), pages, fold)
    return rows.select("qa_id", F.length("text").alias("n_chars"))


_NATIVE = f"WITH {sql_renderings('para')}, {sql_native()}"


@query(_NATIVE + " SELECT page_id || '' AS page_id, pos, text FROM chunks_v WHERE page_id % 2 = 0")
def chunk_replay(spark, sf_dir):
    """Chunks written as JSON lines and read back, of some pages."""
    base = fresh_dir(spark, "chunks")
    sinks.write_chunks(chunk.native_chunks(rendering(spark, sf_dir, "para")).withColumn("page_id", F.col("page_id").cast("string")), base)
    pages = documents(spark, sf_dir).where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("page_id"))
    return corpus.read_chunks(spark, base, pages).select("page_id", "pos", "text")


@query("SELECT 'p' || o_orderkey AS page_id, round(CAST(o_totalprice AS DOUBLE) / 1000, 5) AS rcps_gap, 1 AS n_qa FROM orders")
def preference_source(spark, sf_dir):
    base = fresh_dir(spark, "preferences")
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("page_id"), F.round(F.col("o_totalprice").cast("double") / 1000, 5).alias("rcps_gap"), F.lit(1).alias("n_qa"))
    sinks.write_strict_json(rows, base)
    return corpus.read_preferences(spark, base).select("page_id", "rcps_gap", "n_qa")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def json_checkpoint(spark, sf_dir):
    """JSON lines with a cut-off last line: the last of each key stays."""
    base = fresh_dir(spark, "checkpoint")
    read(spark, sf_dir, "events").select("user_id", "event_id").write.json(base)
    cut = spark.createDataFrame([("part-99999-cut.json", '{"user_id": 1, "event_id": 99999999')], "path string, content string")
    page_files.write_files(cut, base)
    rows = incremental.read_json_checkpoint(spark, base, "user_id long, event_id long", "user_id", "event_id")
    return rows.where("user_id IS NOT NULL")


@query("SELECT count(*) AS n, round(avg(value), 4) AS mean FROM events")
def progress_mean(spark, sf_dir):
    """Count and mean that a job observes while it writes."""
    rows, seen = incremental.running_mean(read(spark, sf_dir, "events"), "value")
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["n"], round(got["mean"], 4))], "n long, mean double")


# -- gates on stored results


@query(_DENSE + ", st AS (SELECT asked, avg(mrr) AS rcps FROM c GROUP BY asked) SELECT CAST(asked AS BIGINT) AS label FROM st WHERE asked % 3 = 0")
def rcps_reconstructs(spark, sf_dir):
    """Stored scores that the mean of their cells does not give: here every third is off by 1e-6."""
    cells = _dense_cube(spark, sf_dir).groupBy("asked", "k").agg(F.avg("mrr").alias("mrr"))
    stored = cells.groupBy("asked").agg((F.avg("mrr") + F.when(F.col("asked") % 3 == 0, 1e-6).otherwise(0.0)).alias("rcps"))
    return gates.reconstruction_faults(cells, stored, ("asked",), "mrr", "rcps").select(F.col("asked").cast("long").alias("label"))


@query(
    "WITH p AS (SELECT doc_id AS page_id, 'train' AS fold FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'eval' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'eval' FROM documents WHERE doc_id % 50 = 1), o AS (SELECT page_id, count(DISTINCT fold) AS n FROM p GROUP BY page_id), w AS (SELECT doc_id AS page_id FROM documents WHERE doc_id % 11 <> 0) "
    "SELECT page_id, CASE WHEN w.page_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'uncovered' ELSE 'overlap' END AS fault FROM o FULL JOIN w USING (page_id) WHERE w.page_id IS NULL OR n IS NULL OR n > 1"
)
def split_faults(spark, sf_dir):
    """Pages in two folds, in none, or outside the evidence."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("page_id"))
    of = lambda test, fold: d.where(test).withColumn("fold", F.lit(fold))
    parts = of("page_id % 3 <> 0", "train").unionByName(of("page_id % 3 = 0 AND page_id % 7 <> 0", "eval")).unionByName(of("page_id % 50 = 1", "eval"))
    return gates.partition_faults(parts, d.where("page_id % 11 <> 0"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 13 = 1 THEN 'hash' WHEN doc_id % 13 = 2 THEN 'size' ELSE 'local path' END AS fault FROM documents WHERE doc_id % 13 < 4")
def release_faults(spark, sf_dir):
    """A stored manifest against the files: some are gone, changed, or name a local path."""
    d = documents(spark, sf_dir)
    i = F.col("doc_id")
    now = sinks.manifest(d.withColumn("path", i.cast("string")).withColumn("text", F.when(i % 13 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))), "path", "text")
    stored = sinks.manifest(d.withColumn("path", i.cast("string")), "path", "text").join(d.select(i.cast("string").alias("path"), (i % 13).alias("m")), "path")
    stored = stored.withColumn("size", F.when(F.col("m") == 2, F.col("size") + 1).otherwise(F.col("size"))).drop("m")
    texts = d.where("doc_id % 13 = 3").select(i.cast("string").alias("path"), F.concat("text", F.lit(" /home/someone/x")).alias("content"))
    gone = d.where("doc_id % 13 = 0").select(i.cast("string").alias("path"))
    return gates.release_faults(now.join(gone, "path", "left_anti"), stored, texts).where("fault <> 'extra'").withColumn("fault", F.when(F.col("fault") == "extra", "missing").otherwise(F.col("fault")))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 4 = 0")
def display_faults(spark, sf_dir):
    """Shown strings that are not what the value gives again."""
    value = F.col("n_nationkey") / 8
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), value.alias("value"), F.format_string("%.2f", F.round(value + F.when(F.col("n_nationkey") % 4 == 0, 0.25).otherwise(0.0), 2)).alias("shown"))
    return gates.display_faults(rows, "value", "shown").select("id")


@query("SELECT sha256(string_agg(h || '  ' || part, chr(10) ORDER BY part)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 3) AS part, sha256(string_agg(sha256(text) || '  ' || doc_id, chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS h, count(*) AS n FROM documents GROUP BY part)")
def manifest_tree(spark, sf_dir):
    return sinks.manifest_tree(sinks.manifest(documents(spark, sf_dir), "doc_id", "text"), "doc_id")


_HEX = "lower(lpad(to_hex(strlen({0})), 16, '0') || hex(encode({0})))"


@query(f"SELECT n_regionkey, sha256(unhex(string_agg({_HEX.format('n_name')} || hex(encode(CAST(n_nationkey AS VARCHAR))), '' ORDER BY n_name))) AS digest FROM nation GROUP BY n_regionkey")
def tree_hash(spark, sf_dir):
    """A tree for each region: nations as paths, their keys as contents."""
    rows = read(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("path"), F.col("n_nationkey").cast("string").alias("content"))
    return sinks.tree_digest(rows, ("n_regionkey",))


@query(_NATIVE + f", b AS (SELECT * FROM (SELECT page_id, pos, page_id || '#' || pos AS key, text AS p, lead(text) OVER (PARTITION BY page_id ORDER BY pos) AS x FROM chunks_v) WHERE x IS NOT NULL) SELECT page_id, sha256(unhex(string_agg({_HEX.format('key')} || {_HEX.format('p')} || {_HEX.format('x')}, '' ORDER BY pos))) AS digest, count(*) AS n FROM b GROUP BY page_id")
def boundary_manifest(spark, sf_dir):
    pairs = chunk.adjacent(chunk.native_chunks(rendering(spark, sf_dir, "para")))
    return sinks.boundary_digest(pairs.withColumn("key", F.concat_ws("#", F.col("page_id").cast("string"), F.col("pos").cast("string"))))


# -- judging


_REPLY = "CASE doc_id % 6 WHEN 0 THEN '{\"label\":\"present\",\"evidence\":\"x\"}' WHEN 1 THEN '{\"label\":\"absent\",\"evidence\":\"\"}' WHEN 2 THEN '{\"label\":\"maybe\",\"evidence\":\"x\"}' WHEN 3 THEN 'no json' WHEN 4 THEN '{\"label\":\"present\"}' ELSE '{\"label\":\"present\",\"evidence\":\"x\",\"more\":1}' END"


@query("SELECT CASE doc_id % 6 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' ELSE 'rejected' END AS label, count(*) AS n FROM documents GROUP BY ALL")
def strict_replies(spark, sf_dir):
    """Replies of a fixed schema; wrong fields, values or no JSON at all are rejected."""
    reply = judge.strict_reply(F.col("reply"), {"label": "string", "evidence": "string"}, {"label": ("present", "degraded", "absent")})
    rows = documents(spark, sf_dir).select(F.expr(_REPLY).alias("reply")).select(F.coalesce(reply["label"], F.lit("rejected")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query(
    "WITH r AS (SELECT source AS parser, lang IS NOT DISTINCT FROM 'en' AS matched, doc_id % 7 <> 0 AS has_page, CASE WHEN source = 'src1' AND doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'present' WHEN doc_id % 3 = 1 THEN 'degraded' ELSE 'absent' END AS label FROM documents), "
    "l AS (SELECT *, CASE WHEN matched THEN NULL WHEN NOT has_page THEN 'absent' ELSE label END AS x FROM r) "
    "SELECT parser, count(*) AS total, count(*) FILTER (WHERE NOT matched) AS missed, count(x) AS judged, count(*) FILTER (WHERE x IS NOT NULL AND has_page) AS with_page, count(*) FILTER (WHERE x = 'present') AS present, count(*) FILTER (WHERE x = 'degraded') AS degraded, count(*) FILTER (WHERE x = 'absent') AS absent, "
    "round(CASE WHEN count(*) FILTER (WHERE x IS NOT NULL AND has_page) > 0 THEN (count(*) FILTER (WHERE x = 'present'))::DOUBLE / count(*) FILTER (WHERE x IS NOT NULL AND has_page) ELSE 0.0::DOUBLE END, 6) AS artifact_share, count(x) = count(*) FILTER (WHERE NOT matched) AS complete, "
    "round(CASE WHEN count(x) = count(*) FILTER (WHERE NOT matched) THEN (count(*) FILTER (WHERE NOT matched) - count(*) FILTER (WHERE x = 'present'))::DOUBLE / count(*) END, 6) AS semantic_absent_rate FROM l GROUP BY parser"
)
def judge_summary(spark, sf_dir):
    i = F.col("doc_id")
    label = F.when((F.col("source") == "src1") & (i % 5 == 0), None).when(i % 3 == 0, "present").when(i % 3 == 1, "degraded").otherwise("absent")
    rows = documents(spark, sf_dir).select(F.col("source").alias("parser"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("matched"), (i % 7 != 0).alias("has_page"), label.alias("label"))
    out = judge.summary(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("artifact_share", "semantic_absent_rate")})


@query(f"WITH {SQL_PROBE} SELECT qa_id, contains(regexp_replace(lower(d.text), '[|*#`>~_\\s]', '', 'g'), regexp_replace(lower(answer_span), '[|*#`>~_\\s]', '', 'g')) OR qa_id % 2 = 0 AS correct FROM qa_v JOIN documents d ON d.doc_id = qa_id + 1 WHERE regexp_replace(lower(answer_span), '[|*#`>~_\\s]', '', 'g') <> ''")
def judged_answers(spark, sf_dir):
    """The shortcut by text, and a judge (here: even ids) for the rest."""
    answers = documents(spark, sf_dir).select((F.col("doc_id") - 1).alias("qa_id"), F.col("text").alias("pred"))
    rows = probe(spark, sf_dir).select("qa_id", F.col("answer_span").alias("gold")).join(answers, "qa_id").where(tx.normalize_for_match(F.col("gold"), False) != "")
    return judge.judged(rows, lambda rest: rest.withColumn("correct", F.col("qa_id") % 2 == 0), exact_unicode=False).select("qa_id", "correct")


# -- values of reports


@query(_PAIR.replace("o_orderpriority, CAST", "o_orderpriority, o_custkey, CAST") + " SELECT o_custkey AS page_id, count(*) AS n_qa, round(100 * avg(treated - control), 3) AS mean_diff_pp FROM p GROUP BY o_custkey")
def page_attribution(spark, sf_dir):
    pages = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("page_id"))
    diffs = _paired(spark, sf_dir).select("o_orderkey", (F.col("treated") - F.col("control")).alias("diff"))
    return metrics.page_attribution(diffs, pages, "diff", "o_orderkey")


@query("SELECT o_custkey AS page_id, count(*) AS n_qa, sum(o_orderkey % 7) AS score FROM orders GROUP BY o_custkey ORDER BY score DESC, page_id LIMIT 3")
def top_pages(spark, sf_dir):
    """The three best pages: a report's top."""
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.count("*").alias("n_qa"), F.sum(F.col("o_orderkey") % 7).alias("score"))
    return metrics.best_rows(rows, "score", "page_id", 3)


@query(_DENSE + "SELECT CAST(k AS BIGINT) AS k, round(avg(hit), 6) AS hit, count(*) FILTER (WHERE (mrr > 0) <> (hit > 0)) AS differ FROM c GROUP BY k")
def hit_from_mrr(spark, sf_dir):
    cells = _dense_cube(spark, sf_dir).withColumn("derived", metrics.hit_of_mrr(F.col("mrr")))
    return cells.groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.avg("derived"), 6).alias("hit"), F.count(F.when(F.col("derived") != F.col("hit"), 1)).alias("differ"))


@query(_DENSE + ", x AS (SELECT 'rcps' AS series, qid, mrr FROM c UNION ALL SELECT 'hit@1', qid, mrr FROM c WHERE k = 1 UNION ALL SELECT 'mrr@10', qid, mrr FROM c WHERE k = 10) SELECT series, round(avg(v), 6) AS mean FROM (SELECT series, qid, avg(mrr) AS v FROM x GROUP BY ALL) GROUP BY series")
def metric_series(spark, sf_dir):
    cells = _dense_cube(spark, sf_dir).select(F.lit("dense").alias("system"), F.col("qid").alias("qa_id"), F.lit("mrr").alias("metric"), "k", F.col("mrr").alias("value"))
    parts = [metrics.series(cells, name).select(F.lit(name).alias("series"), "value") for name in metrics.SERIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("series").agg(F.round(F.avg("value"), 6).alias("mean"))


@query(_DENSE + "SELECT coalesce(CAST(asked AS VARCHAR), 'overall') AS label, round(avg(mrr), 6) AS rcps, round(avg(hit) FILTER (WHERE k = 1), 6) AS hit1 FROM c GROUP BY GROUPING SETS ((asked), ())")
def rcps_with_overall(spark, sf_dir):
    cells = _dense_cube(spark, sf_dir).withColumn("retriever", F.lit("dense"))
    own = metrics.rcps(cells, ("asked",)).select(F.col("asked").cast("string").alias("label"), "rcps", "hit1")
    out = own.unionByName(metrics.rcps(cells).select(F.lit("overall").alias("label"), "rcps", "hit1"))
    return out.withColumns({c: F.round(c, 6) for c in ("rcps", "hit1")})


@query("SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY ALL")
def ordered_unique(spark, sf_dir):
    """Distinct pairs with the place where each comes first."""
    return prefer.first_places(documents(spark, sf_dir), ("source", "lang"), "doc_id", "first")


@query("SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 10 // 1 / 10.0::DOUBLE + n_nationkey // 10 END AS scale FROM nation")
def scale_names(spark, sf_dir):
    name = F.concat(F.lit("run_"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("lambda"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))).otherwise("base"), F.lit("_eval"))
    return read(spark, sf_dir, "nation").select("n_name", tx.scale_of_name(name).alias("scale"))


@query("SELECT c_nationkey, printf('%.2f [%.2f, %.2f]', round(avg(CAST(c_acctbal AS DOUBLE)) / 7, 2), min(CAST(c_acctbal AS DOUBLE)), max(CAST(c_acctbal AS DOUBLE))) AS shown FROM customer GROUP BY c_nationkey")
def interval_text(spark, sf_dir):
    v = F.col("c_acctbal").cast("double")
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.avg(v) / 7).alias("m"), F.min(v).alias("a"), F.max(v).alias("z")).select("c_nationkey", tx.interval_text(F.col("m"), F.col("a"), F.col("z"), 2).alias("shown"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE '../../images/documents/doc' || page_id % 7 || '/' || page_id || '.png' END AS link FROM pages")
def image_links(spark, sf_dir):
    i = F.col("page_id").cast("string")
    path = F.concat(F.lit("/data"), F.when(F.col("page_id") % 4 != 0, "/images/").otherwise("/other/"), F.lit("documents/doc"), (F.col("page_id") % 7).cast("string"), F.lit("/"), i, F.lit(".png"))
    return read(spark, sf_dir, "pages").select("page_id", tx.relative_image(path, "/data/images", "/data/out/sheets").alias("link"))


@query("WITH f(family, severity, parser) AS (VALUES ('fast', 'clean', '1-URGENT'), ('fast', 'mild', '2-HIGH'), ('slow', 'clean', '5-LOW'), ('slow', 'severe', '3-MEDIUM'), ('none', 'clean', '6-NEVER')), m AS (SELECT o_orderpriority AS parser, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS bc, round(avg(o_orderkey), 4) AS rcps FROM orders GROUP BY ALL) SELECT family, severity, bc, rcps FROM f JOIN m USING (parser)")
def noise_families(spark, sf_dir):
    """Scores by family and severity of noise: a small table of names; names without scores are left out."""
    modes = [("fast", "clean", "1-URGENT"), ("fast", "mild", "2-HIGH"), ("slow", "clean", "5-LOW"), ("slow", "severe", "3-MEDIUM"), ("none", "clean", "6-NEVER")]
    scores = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("parser")).agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 4).alias("bc"), F.round(F.avg("o_orderkey"), 4).alias("rcps"))
    return metrics.by_family(scores, modes, "parser").select("family", "severity", "bc", "rcps")


@query("SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM (SELECT CAST(ps AS DOUBLE) AS x, CAST(pr AS DOUBLE) AS y FROM (SELECT p_size AS ps, p_retailprice AS pr, p_partkey FROM part) WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0)")
def finite_correlation(spark, sf_dir):
    """Rows with NaN or infinity on a side do not count."""
    i = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(F.when(i % 9 == 0, float("nan")).otherwise(F.col("p_size").cast("double")).alias("x"), F.when(i % 11 == 0, float("inf")).otherwise(F.col("p_retailprice").cast("double")).alias("y"))
    return rows.where(gates.finite("x", "y")).agg(F.count("*").alias("n"), F.round(st.pearson("x", "y"), 6).alias("r"))


_VARIANTS = f"WITH {sql_renderings('para', 'trunc')}, {sql_native()}"


@query(_VARIANTS + ", p AS (SELECT system, count(*) AS n_pages, avg(length(markdown)) AS mean, median(length(markdown)) AS median FROM pages_v GROUP BY system), c AS (SELECT system, count(*) AS n_chunks, avg(length(text)) AS chunk_mean FROM chunks_v GROUP BY system) SELECT system, n_pages, round(mean, 4) AS mean, CAST(floor(median) AS BIGINT) AS median, round(n_chunks::DOUBLE / n_pages, 6) AS chunks_per_page, round(chunk_mean, 4) AS chunk_mean FROM p JOIN c USING (system)")
def variant_stats(spark, sf_dir):
    """Structure of each rendering, in one pass over its pages."""
    pages = renderings(spark, sf_dir, "para", "trunc").select("system", F.length("markdown").alias("n"), F.transform(chunk.native_pieces(F.col("markdown"), 30), F.length).alias("sizes"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = pages.groupBy("system").agg(F.count("*").alias("n_pages"), F.round(F.avg("n"), 4).alias("mean"), F.floor(F.median("n")).alias("median"), F.sum(F.size("sizes")).alias("c"), F.sum(total(F.col("sizes"))).alias("t"))
    return out.select("system", "n_pages", "mean", "median", F.round(F.col("c") / F.col("n_pages"), 6).alias("chunks_per_page"), F.round(F.col("t") / F.col("c"), 4).alias("chunk_mean"))


@query("SELECT regexp_extract(url, '^[a-z]+://(?:[^/]*\\.)?([a-z]+)(?:[/?#:]|$)', 1) AS domain, count(*) AS n FROM pages GROUP BY ALL")
def domain_counts(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"^[a-z]+://(?:[^/]*\.)?([a-z]+)(?:[/?#:]|$)", 1).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_matches(html, '(?i)<table[\\s>]') AS has_table FROM pages")
def table_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", tx.has_table(F.col("html")).alias("has_table"))


# -- retrieval with an encoder


def _vector_sql(text: str) -> str:
    cells = f"list_transform(regexp_extract_all(lower({text}), '{tx.TOKEN}'), lambda x: CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % 64)"
    return f"list_transform(range(64), lambda i: len(list_filter({cells}, lambda c: c = i))::DOUBLE)"


@query(
    f"WITH {sql_renderings('para')}, {sql_native()}, {SQL_PROBE}, q AS MATERIALIZED (SELECT qa_id, {_vector_sql(chr(39) + 'query: ' + chr(39) + ' || question')} AS v FROM qa_v), "
    f"d AS MATERIALIZED (SELECT page_id || '::parser_native#' || pos AS chunk_id, {_vector_sql(chr(39) + 'passage: ' + chr(39) + ' || text')} AS v FROM chunks_v), "
    "s AS (SELECT qa_id, chunk_id, round(list_dot_product(q.v, d.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-12) * greatest(sqrt(list_dot_product(d.v, d.v)), 1e-12)), 6) AS score FROM q CROSS JOIN d) "
    "SELECT qa_id, chunk_id, score, CAST(rk AS BIGINT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, chunk_id) AS rk FROM s) WHERE rk <= 5"
)
def encoded_search(spark, sf_dir):
    """Chunks are encoded once, queries with their own prefix; the encoder is a stand-in that any other can replace."""
    encoder = retrieve.hashed_encoder()
    base = fresh_dir(spark, "index")
    chunks = chunk.native_chunks(spread(rendering(spark, sf_dir, "para"), "page_id"))
    kept(retrieve.index(chunks, encoder, "asymmetric").select("chunk_id", "embedding"), base, compression="zstd")
    return retrieve.search_files(probe(spark, sf_dir).select("qa_id", "question"), base, encoder, 5, "asymmetric").withColumn("rk", F.col("rk").cast("long"))


@query("SELECT vec_id, round(CAST(embedding AS DOUBLE[])[1], 6) AS head FROM embeddings WHERE vec_id % 3 = 0")
def vector_cache(spark, sf_dir):
    """Vectors kept under a fingerprint, looked up by key."""
    store, made = fresh_dir(spark, "vectors"), {"encoder": "stored", "version": 1}
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    incremental.save_vectors(rows, store, made)
    got = incremental.load_vectors(spark, store, made, rows.where("vec_id % 3 = 0"), "vec_id")
    return got.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))


@query("SELECT vec_id, round((CAST(embedding AS DOUBLE[])[2] + CAST(embedding AS DOUBLE[])[3]) / 2, 6) AS inside, round(list_sum(CAST(embedding AS DOUBLE[])[1:4]) / 4, 6) AS fallback FROM embeddings")
def span_pooling(spark, sf_dir):
    """Late pooling: the mean over a chunk's own tokens, and over all of them where it has none (first four numbers as tokens)."""
    rows = F.transform(F.slice("embedding", 1, 4), lambda x: F.array(x.cast("double")))
    every = F.array(*(F.lit(1) for _ in range(4)))
    inside, none = (vx.span_mean(rows, F.array(F.lit(a)), F.array(F.lit(b)), every) for a, b in ((1, 3), (2, 2)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(inside[0], 6).alias("inside"), F.round(none[0], 6).alias("fallback"))


@query(_CUBE + " SELECT system, round(avg(value), 6) AS mean, count(*) AS n FROM c WHERE system <> 'A-F' GROUP BY system")
def full_coverage_pivot(spark, sf_dir):
    """Rows of queries that every system has, of the named systems only."""
    return _cube(spark, sf_dir).where("system <> 'A-F'").groupBy("system").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
