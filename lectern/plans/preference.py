"""Queries of preference data, sampling, joins of records, and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx, vectors as vx
from ..operators import coverage, prefer, retrieve, sample
from ..operators.chunk import native_chunks, native_pieces
from ..streaming import incremental, keyed
from .registry import query
from ..session import fresh_dir
from .views import SQL_PROBE, documents, probe, read, rendering, renderings, sql_native, sql_renderings


#: Items of a page's pool.
POOL = 100


def _candidates(spark, sf_dir) -> DataFrame:
    """Orders as pages, their lines as candidates (numbered, as line numbers repeat), a price share as the score."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), n.alias("candidate_idx"), F.round(F.col("l_discount").cast("double") * 10, 6).alias("score"))


_CAND = "WITH c AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS candidate_idx, round(CAST(l_discount AS DOUBLE) * 10, 6) AS score FROM lineitem)"


def _best(order: str) -> str:
    other = "ASC" if order == "DESC" else "DESC"
    return (
        _CAND + f", b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score {order}, candidate_idx) AS hi, row_number() OVER (PARTITION BY page_id ORDER BY score {other}, candidate_idx DESC) AS lo, count(*) OVER (PARTITION BY page_id) AS n FROM c), "
        "p AS (SELECT page_id, max(n) AS n, max(candidate_idx) FILTER (WHERE hi = 1) AS chosen, max(candidate_idx) FILTER (WHERE lo = 1) AS rejected, max(score) FILTER (WHERE hi = 1) AS chosen_score, max(score) FILTER (WHERE lo = 1) AS rejected_score FROM b GROUP BY page_id) "
        "SELECT page_id, CAST(chosen AS INT) AS chosen, CAST(rejected AS INT) AS rejected, chosen_score, rejected_score FROM p WHERE n >= 2 AND abs(chosen_score - rejected_score) >= 0.3::DOUBLE"
    )


@query(_best("DESC"))
def pairs_best_worst(spark, sf_dir):
    return prefer.best_and_worst(_candidates(spark, sf_dir), 0.3).drop("gap")


@query(_best("ASC"))
def pairs_closest_farthest(spark, sf_dir):
    return prefer.best_and_worst(_candidates(spark, sf_dir), 0.3, ascending=True).drop("gap")


@query(_CAND + " SELECT page_id, CAST(min(candidate_idx) AS INT) AS candidate_idx FROM c WHERE candidate_idx <> 0 OR page_id % 2 = 0 GROUP BY page_id")
def representative_candidate(spark, sf_dir):
    return prefer.representative(_candidates(spark, sf_dir).where("candidate_idx <> 0 OR page_id % 2 = 0"))


@query("SELECT doc_id, min_by(src, src) AS src FROM (SELECT doc_id, 0 AS src FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM labels) GROUP BY doc_id")
def merge_keep_first(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id")
    parts = [d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"), read(spark, sf_dir, "labels").select("doc_id")]
    rows = parts[0].withColumn("src", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("src", F.lit(i)))
    return prefer.keep_first(rows, ("doc_id",), "src")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY ALL")
def last_wins(spark, sf_dir):
    return prefer.keep_last(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ("user_id", "event_type"), "event_id")


_POS = f"WITH {sql_renderings('para')}, {sql_native()}, {SQL_PROBE}"


@query(_POS + ", h AS (SELECT qa_id, min(pos) AS pos FROM qa_v q JOIN chunks_v c USING (page_id) WHERE contains(c.text, q.answer_span) GROUP BY qa_id) SELECT q.qa_id, CASE WHEN h.pos IS NULL THEN NULL ELSE q.page_id || '::parser_native#' || h.pos END AS chunk_id FROM qa_v q LEFT JOIN h USING (qa_id)")
def qa_positive_chunks(spark, sf_dir):
    return prefer.positives_in(probe(spark, sf_dir), rendering(spark, sf_dir, "para"), native_pieces(F.col("markdown"), 30), "parser_native").select("qa_id", "chunk_id")


@query(_POS + ", h AS (SELECT q.page_id, pos FROM qa_v q JOIN chunks_v c USING (page_id) WHERE contains(c.text, q.answer_span)) SELECT count(*) AS n_rows, count(h.pos) AS positive, count(DISTINCT c.page_id || '#' || c.pos) AS chunks, median(c.n)::DOUBLE AS median_per_page FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM chunks_v) c LEFT JOIN h ON h.page_id = c.page_id AND h.pos = c.pos")
def cache_manifest(spark, sf_dir):
    """One row for each chunk and query that hits it, or one without a query."""
    from pyspark.sql import Window

    chunks = native_chunks(rendering(spark, sf_dir, "para")).withColumn("n", F.count("*").over(Window.partitionBy("page_id")))
    hits = chunks.join(probe(spark, sf_dir).select("page_id", "qa_id", "answer_span"), "page_id").where(F.contains("text", "answer_span")).select("chunk_id", "qa_id")
    rows = chunks.select("chunk_id", "n").join(hits, "chunk_id", "left")
    return rows.agg(F.count("*").alias("n_rows"), F.count("qa_id").alias("positive"), F.countDistinct("chunk_id").alias("chunks"), F.median("n").alias("median_per_page"))


@query("WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.label AS page, b.vec_id, round(max(list_dot_product(a.e, b.e)), 6) AS sim FROM e a JOIN e b ON a.label <> b.label WHERE a.vec_id % 50 = 0 GROUP BY ALL) SELECT CAST(page AS BIGINT) AS page, vec_id, sim, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY sim DESC, vec_id) AS rk FROM s) WHERE rk <= 100")
def hard_negatives(spark, sf_dir):
    """Labels as pages: the vectors of other labels nearest to any of the label's queries (every 50th vector)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("item"), F.col("label").cast("long").alias("owner"), F.col("embedding").alias("vector"))
    asks = e.where("item % 50 = 0").withColumnRenamed("owner", "page")
    sims = retrieve.nearest_of_others(asks, e, POOL).withColumnRenamed("item", "vec_id")
    return prefer.hard_negatives(sims, POOL, "page", "vec_id")


#: Chunks and pages on a ring of cells by md5; a page takes the next ones of other pages.
_RING = (
    f"WITH {sql_renderings('para')}, {sql_native()}, {SQL_PROBE}, n AS (SELECT greatest(1, count(*) // {POOL}) AS cells FROM chunks_v), "
    "ck AS MATERIALIZED (SELECT page_id AS owner, page_id || '::parser_native#' || pos AS chunk_id, text, md5(page_id || '::parser_native#' || pos || '-42') AS h FROM chunks_v), "
    "rc AS MATERIALIZED (SELECT owner, chunk_id, text, h, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % cells AS cell FROM ck, n), "
    "rp AS MATERIALIZED (SELECT doc_id AS page_id, CAST(('0x' || substr(md5(doc_id || '-42'), 1, 8)) AS BIGINT) % cells AS first, cells FROM documents, n{where}), "
    f"pool AS (SELECT page_id, chunk_id, rk FROM (SELECT page_id, chunk_id, row_number() OVER (PARTITION BY page_id ORDER BY (cell - first + cells) % cells, h, chunk_id) AS rk FROM rp JOIN rc ON owner <> page_id) WHERE rk <= {POOL})"
)


def _stored_chunks(spark, sf_dir) -> DataFrame:
    """The ids of chunks, written first, as they are read again."""
    base = fresh_dir(spark, "chunks")
    native_chunks(rendering(spark, sf_dir, "para")).select("page_id", "chunk_id").write.parquet(base)
    return spark.read.parquet(base)


@query(_RING.replace("{where}", "") + " SELECT page_id, chunk_id, CAST(rk AS INT) AS rk FROM pool")
def distractor_pool(spark, sf_dir):
    return prefer.distractors(documents(spark, sf_dir).select(F.col("doc_id").alias("page_id")), _stored_chunks(spark, sf_dir), POOL).withColumn("rk", F.col("rk").cast("int"))


#: Distinct terms of a text, and the share of two term sets that both have.
def _terms(column: str):
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit(tx.TOKEN), F.lit(0)))


def _jaccard(a, b):
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


_CANDIDATES = ("para", "nolines", "trunc")


@query(
    _RING.replace("{where}", " WHERE doc_id % 50 = 0")
    + f""", {sql_renderings(*_CANDIDATES).replace('pages_v', 'pages_c')}, {sql_native('pages_c').replace('parts_v', 'parts_c').replace('listed_v', 'listed_c').replace('chunks_v', 'chunks_c')},
asks AS (SELECT qa_id, page_id, answer_span, list_distinct(regexp_extract_all(lower(question), '{tx.TOKEN}')) AS ask FROM qa_v WHERE qa_id % 50 = 0),
own AS (SELECT page_id, system AS candidate, page_id || '::' || system || '#' || pos AS chunk_id, text, list_distinct(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS item FROM chunks_c WHERE page_id % 50 = 0),
mine AS MATERIALIZED (SELECT qa_id, page_id, candidate, chunk_id, contains(text, answer_span) AS good, round(coalesce(len(list_intersect(ask, item))::DOUBLE / nullif(len(ask) + len(item) - len(list_intersect(ask, item)), 0), 0), 6) AS s FROM asks JOIN own USING (page_id)),
others AS MATERIALIZED (SELECT qa_id, page_id, chunk_id, round(coalesce(len(list_intersect(ask, item))::DOUBLE / nullif(len(ask) + len(item) - len(list_intersect(ask, item)), 0), 0), 6) AS s FROM asks JOIN pool USING (page_id) JOIN (SELECT chunk_id, list_distinct(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS item FROM rc) USING (chunk_id)),
al AS (SELECT page_id, candidate, qa_id, chunk_id, s, good FROM mine UNION ALL SELECT c.page_id, c.candidate, o.qa_id, o.chunk_id, o.s, FALSE FROM others o JOIN (SELECT DISTINCT page_id, candidate FROM own) c USING (page_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY page_id, candidate, qa_id ORDER BY s DESC, chunk_id) AS rk FROM al),
f AS (SELECT page_id, candidate, qa_id, min(rk) FILTER (WHERE good) AS rk FROM rk GROUP BY ALL)
SELECT page_id, candidate, count(DISTINCT qa_id) AS n_qa, round(avg(CASE WHEN rk <= k THEN 1.0::DOUBLE / rk ELSE 0.0::DOUBLE END), 6) AS rcps FROM f CROSS JOIN (VALUES (1), (5), (10)) t(k) GROUP BY ALL"""
)
def candidate_scores(spark, sf_dir):
    """Renderings as candidates of a page: each is chunked, and its chunks are ranked among the page's pool for the page's queries."""
    asks = probe(spark, sf_dir).where("qa_id % 50 = 0").select("page_id", "qa_id", "answer_span", _terms("question").alias("ask"))
    pages = renderings(spark, sf_dir, *_CANDIDATES).join(F.broadcast(asks.select("page_id").distinct()), "page_id", "left_semi")
    own = native_chunks(pages).join(asks.select("page_id", "qa_id", "answer_span"), "page_id").select(
        "page_id", F.col("system").alias("candidate"), F.concat(F.col("page_id").cast("string"), F.lit("::"), "system", F.lit("#"), F.col("pos").cast("string")).alias("chunk_id"),
        _terms("text").alias("item"), F.when(F.contains("text", "answer_span"), F.array("qa_id")).otherwise(F.array().cast("array<bigint>")).alias("relevant"),
    )
    pool = prefer.distractors(asks.select("page_id").distinct(), _stored_chunks(spark, sf_dir), POOL)
    texts = native_chunks(rendering(spark, sf_dir, "para")).select("chunk_id", _terms("text").alias("item"))
    return retrieve.candidate_scores(asks.drop("answer_span"), own, pool.select("page_id", "chunk_id").join(texts, "chunk_id"), _jaccard)


_HARD = (
    "WITH e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.label AS page, b.vec_id, round(max(list_dot_product(a.e, b.e)), 6) AS sim FROM e a JOIN e b ON a.label <> b.label WHERE a.vec_id % 50 = 0 GROUP BY ALL), "
    "pool AS MATERIALIZED (SELECT page, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY sim DESC, vec_id) AS rk FROM s) WHERE rk <= 100), "
    "asks AS (SELECT vec_id AS qa_id, label AS page, e FROM e WHERE vec_id % 50 = 0), "
    "al AS (SELECT a.page, o.vec_id % 3 AS candidate, a.qa_id, o.vec_id, round(list_dot_product(a.e, o.e), 6) AS s, o.vec_id // 3 % 7 = a.qa_id % 7 AS good FROM asks a JOIN e o ON o.label = a.page AND o.vec_id <> a.qa_id UNION ALL "
    "SELECT a.page, c.candidate, a.qa_id, p.vec_id, round(list_dot_product(a.e, o.e), 6), FALSE FROM asks a JOIN (VALUES (0), (1), (2)) c(candidate) ON TRUE JOIN pool p ON p.page = a.page JOIN e o ON o.vec_id = p.vec_id WHERE EXISTS (SELECT 1 FROM e x WHERE x.label = a.page AND x.vec_id % 3 = c.candidate)), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY page, candidate, qa_id ORDER BY s DESC, vec_id) AS rk FROM al), f AS (SELECT page, candidate, qa_id, min(rk) FILTER (WHERE good) AS rk FROM rk GROUP BY ALL) "
    "SELECT CAST(page AS BIGINT) AS page, CAST(candidate AS INT) AS candidate, count(DISTINCT qa_id) AS n_qa, round(avg(CASE WHEN rk <= k THEN 1.0::DOUBLE / rk ELSE 0.0::DOUBLE END), 6) AS rcps FROM f CROSS JOIN (VALUES (1), (5), (10)) t(k) GROUP BY ALL"
)


@query(_HARD)
def candidate_scores_hard(spark, sf_dir):
    """As ``candidate_scores``, on vectors: labels as pages, thirds of a label's vectors as its candidates, hard negatives as the pool."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("item"), F.col("label").cast("long").alias("owner"), F.col("embedding").alias("vector"))
    asks = e.where("item % 50 = 0").withColumnRenamed("owner", "page")
    pool = prefer.hard_negatives(retrieve.nearest_of_others(asks, e, POOL), POOL, "page", "item")
    asked = asks.select(F.col("page").alias("page_id"), F.col("item").alias("qa_id"), F.col("vector").alias("ask"), (F.col("item") % 7).alias("topic"))
    own = e.select(F.col("owner").alias("page_id"), (F.col("item") % 3).cast("int").alias("candidate"), F.col("item").alias("chunk_id"), F.col("vector").alias("item"), (F.floor(F.col("item") / 3) % 7).alias("topic"))
    own = own.join(F.broadcast(asked.select("page_id").distinct()), "page_id", "left_semi")
    pool = pool.select(F.col("page").alias("page_id"), F.col("item").alias("chunk_id")).join(e.select(F.col("item").alias("chunk_id"), F.col("vector").alias("item")), "chunk_id")
    return retrieve.dense_candidate_scores(asked, own, pool).withColumnRenamed("page_id", "page")


_NEGATIVES = _POS + (
    ", h AS (SELECT qa_id, min(pos) AS pos FROM qa_v q JOIN chunks_v c USING (page_id) WHERE contains(c.text, q.answer_span) GROUP BY qa_id), ids AS (SELECT page_id, page_id || '::parser_native#' || pos AS chunk_id FROM chunks_v), "
    "o AS (SELECT q.qa_id, ids.chunk_id AS other FROM h JOIN qa_v q USING (qa_id) JOIN ids USING (page_id) WHERE ids.chunk_id <> q.page_id || '::parser_native#' || h.pos), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY md5('0-' || qa_id || '-' || other), other) AS rk FROM o), p AS (SELECT qa_id, list(other ORDER BY rk) AS pool FROM r WHERE rk <= 4 GROUP BY qa_id) "
    "SELECT qa_id, CAST(i AS INT) AS slot, pool[i % len(pool) + 1] AS chunk_id FROM (SELECT qa_id, pool, unnest(range(4)) AS i FROM p)"
)


@query(_NEGATIVES)
def sampled_negatives(spark, sf_dir):
    chunks = native_chunks(rendering(spark, sf_dir, "para")).select("page_id", "chunk_id", "pos", "text")
    anchors = prefer.positives(probe(spark, sf_dir), chunks).where("chunk_id IS NOT NULL")
    return prefer.sampled_negatives(anchors, chunks.select("page_id", "chunk_id"), 4)


_SPLIT = "WITH d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42-' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)"


@query(_SPLIT + " SELECT doc_id, CASE WHEN p <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' ELSE 'eval' END AS fold FROM d")
def stratified_split(spark, sf_dir):
    return sample.stratified_split(documents(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id", ("source", "lang")).select("doc_id", "fold")


@query(_SPLIT + " SELECT CASE WHEN p <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' ELSE 'eval' END AS fold, lang, count(*) AS n FROM d GROUP BY ALL")
def fold_statistics(spark, sf_dir):
    return sample.stratified_split(documents(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id", ("source", "lang")).groupBy("fold", "lang").agg(F.count("*").alias("n"))


@query(
    "WITH c AS (SELECT doc_id, lang, md5('42-' || doc_id) AS h, greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 100.0::DOUBLE / count(*) OVER (), 0)) AS q FROM documents), s AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) > q)::INT AS spare FROM c) "
    "SELECT doc_id, lang FROM s ORDER BY spare, h, doc_id LIMIT 100"
)
def stratified_sample(spark, sf_dir):
    return sample.stratified_sample(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", ("lang",), 100).select("doc_id", "lang")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || source || '|' || doc_id), doc_id) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3')) WHERE n <= CASE source WHEN 'src1' THEN 50 WHEN 'src2' THEN 30 ELSE 20 END")
def blind_sample(spark, sf_dir):
    rows = sample.quota_sample(documents(spark, sf_dir).select("doc_id", "source"), "doc_id", "source", {"src1": 50, "src2": 30, "src3": 20})
    return rows.select("doc_id", "source")


@query(f"WITH {SQL_PROBE} SELECT q.source, count(*) AS n, round(avg(contains(lower(d.text), lower(q.answer_span))::INT), 6) AS em, round(avg((length(trim(d.text)) > 0)::INT), 6) AS answered FROM qa_v q JOIN documents d ON d.doc_id = q.qa_id + 1 GROUP BY q.source")
def answer_accuracy(spark, sf_dir):
    """The shortcut before a judge: gold inside the prediction (here: the next document)."""
    answers = documents(spark, sf_dir).select((F.col("doc_id") - 1).alias("qa_id"), F.col("text").alias("pred"))
    rows = probe(spark, sf_dir).select("qa_id", "source", "answer_span").join(answers, "qa_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.contains(F.lower("pred"), F.lower("answer_span")).cast("double")), 6).alias("em"), F.round(F.avg((F.length(F.trim("pred")) > 0).cast("double")), 6).alias("answered"))


@query(f"WITH {SQL_PROBE} SELECT qa_id FROM qa_v JOIN documents ON doc_id = page_id WHERE length(regexp_replace(lower(answer_span), '[|*#`>~_\\s]', '', 'g')) >= 24 AND lower(trim(answer_span)) <> 'none'")
def answerable_probe(spark, sf_dir):
    pages = rendering(spark, sf_dir, "raw").select("page_id", "markdown")
    return coverage.answerable(probe(spark, sf_dir), pages, ("none",), 24).select("qa_id")


@query("SELECT a.doc_id AS doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = 0 AND substr(sha256(CAST(l.doc_id AS VARCHAR)), 1, 8) = substr(sha256(CAST(a.doc_id AS VARCHAR)), 1, 8))")
def prefix_anti_match(spark, sf_dir):
    """Rejected ids are known by their first eight characters only."""
    key = F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 8).alias("prefix")
    bad = read(spark, sf_dir, "labels").where("quality = 0").select(key)
    return documents(spark, sf_dir).select("doc_id", key).join(bad, "prefix", "left_anti").select("doc_id")


@query("SELECT doc_id, len(list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = 'the' AND w[i + 2] = 'of')) > 0 AS found, coalesce(list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = 'the' AND w[i + 2] = 'of')[1], -1) AS at FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def subsequence_place(spark, sf_dir):
    """The first place of two words in the words of a text."""
    words = F.split("text", " ")
    rows = documents(spark, sf_dir).select("doc_id", vx.find_subsequence(words, F.array(F.lit("the"), F.lit("of"))).cast("long").alias("at"))
    return rows.select("doc_id", (F.col("at") >= 0).alias("found"), "at")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def events_incremental(spark, sf_dir):
    """The events table as a file stream, drained into a store, and read back."""
    base = fresh_dir(spark, "stream")
    schema = read(spark, sf_dir, "events").schema
    events = f"{sf_dir}/events.parquet"
    source = incremental.file_stream(spark, events if _is_folder(spark, events) else f"{sf_dir}/[e]vents.parquet", schema)
    incremental.drain(source, lambda rows, epoch: rows.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/rows"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, arg_max(value, (ts, value)) AS value, max(ts) AS at, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def events_keyed_state(spark, sf_dir):
    """The events as files of a stream in two halves, the second after a restart on the same checkpoint: the last row and running mean of each user."""
    base = fresh_dir(spark, "keyed")
    events = read(spark, sf_dir, "events").select("user_id", "ts", "value")
    for half in (0, 1):
        events.where(F.pmod(F.xxhash64("user_id", "ts", "value"), F.lit(2)) == half).write.mode("append").parquet(f"{base}/in")
        source = incremental.file_stream(spark, f"{base}/in", events.schema)
        made = keyed.latest(source, "user_id", "ts", "value")
        store = lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")
        made.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.max(F.struct("batch", "at", "value", "n", "mean")).alias("l"))
    kind = dict(events.dtypes)["ts"]
    return last.select("user_id", "l.value", F.col("l.at").cast(kind).alias("at"), "l.n", F.round("l.mean", 6).alias("mean"))


def _is_folder(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return incremental.tumbling(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, s.s")
def events_sessions(spark, sf_dir):
    return incremental.sessions(read(spark, sf_dir, "events"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '" + tx.TOKEN + "')) AS n FROM documents")
def store_resume(spark, sf_dir):
    """A store is filled in two runs; the second scores only what the first left."""
    base = fresh_dir(spark, "store")
    incremental.bind(spark, base, {"rule": "tokens", "version": 1})
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), "text")
    schema = "key string, value long, seq int"
    count = lambda seq: lambda part: part.select("key", F.size(tx.tokens(F.col("text"), False)).cast("long").alias("value"), F.lit(seq).alias("seq"))
    incremental.score_pending(rows.where("cast(key AS long) % 2 = 0"), base, "key", count(0), schema)
    return incremental.score_pending(rows, base, "key", count(1), schema).select(F.col("key").cast("long").alias("doc_id"), F.col("value").alias("n"))
