"""Whole jobs on larger tables: bounded disk and memory, and no question left out."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import chunk, hooks, lexical, retrieve
from lectern.plans import catalog
from lectern.sources import corpus


def _corpus(spark, rng, n=60):
    text = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 60]
    rows = [(s, f"{i}#{s}", text(int(rng.integers(0, 30)))) for s in "ab" for i in range(n)] + [("a", f"copy{i}", ["w1", "w2", "w3"]) for i in range(40)] + [("b", "none", []), ("c", "void", None)]
    asked = [(i, text(8)) for i in range(12)] + [(90, ["w1", "w2", "w3", "w1"]), (91, ["unknown"]), (92, []), (93, None)]
    return spark.createDataFrame(rows, "system string, chunk_id string, terms array<string>"), spark.createDataFrame(asked, "qa_id long, terms array<string>")


def _joins(docs, asked):
    words = retrieve.asked_terms(asked)
    pairs = retrieve.asked_terms(asked.withColumn("terms", retrieve.word_pairs(F.col("terms"))))
    return {
        "bm25": retrieve.bm25_scores(words, docs, ("system",)),
        "jaccard": retrieve.jaccard_scores(words, docs, ("system",)),
        "pairs": retrieve.cosine_scores(pairs, docs.withColumn("terms", retrieve.word_pairs(F.col("terms"))), ("system",)),
    }


@pytest.mark.parametrize("step", [1 << 22, 50])
def test_no_chunk_is_exchanged(spark, monkeypatch, step):
    """chunks stay in their tasks, for queries in several parts; what is kept equals the joins."""
    docs, asked = _corpus(spark, np.random.default_rng(5))
    docs = docs.where("terms IS NOT NULL").repartition(3)
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/no-exchange-{step}")
    docs = spark.read.parquet(path)
    monkeypatch.setattr(retrieve, "TERMS_STEP", step)
    monkeypatch.setattr(lexical, "QUERIES", 6)
    found = retrieve.lexical_best(asked, docs, 5, ("system",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CoGroup" not in plan and plan.count("MapInArrow") == 3
    top = lambda s: {(r.system, r.qa_id, r.rk): (r.chunk_id, r.score) for r in retrieve.top_k(s, 5, ("system", "qa_id")).collect()}
    found = found.cache()
    for name, scores in _joins(docs, asked).items():
        assert top(scores) == top(found.where(F.col("retriever") == name))


@pytest.mark.parametrize("step", [1 << 22, 50])
def test_ranks(spark, monkeypatch, step):
    """F2 to F4: counting what comes before the sought chunk gives the rank that ranked lists give, copies and ties by id too."""
    docs, asked = _corpus(spark, np.random.default_rng(7))
    monkeypatch.setattr(retrieve, "TERMS_STEP", step)
    monkeypatch.setattr(lexical, "QUERIES", 6)
    monkeypatch.setattr(lexical, "SLICE", 7)
    docs = docs.repartition(3)
    own = docs.crossJoin(asked.select("qa_id", F.col("terms").alias("asked"))).where(F.pmod(F.xxhash64("chunk_id", "qa_id"), F.lit(9)) == 0)
    own = own.withColumns({"a": F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0, "b": F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0})
    for most in (3, 10):
        got = retrieve.lexical_ranks(asked, docs, own, ("a", "b"), most, ("system",)).collect()
        found, sought = 0, own.select("system", "qa_id", "chunk_id", "a", "b").collect()
        for name, scores in _joins(docs.where("terms IS NOT NULL"), asked).items():
            at = {(r.system, r.qa_id, r.chunk_id): r.rk for r in retrieve.top_k(scores, most, ("system", "qa_id")).collect()}
            for flag in ("a", "b"):
                want: dict = {}
                for r in sought:
                    if r[flag] and (rk := at.get((r.system, r.qa_id, r.chunk_id))):
                        want[r.system, r.qa_id] = min(rk, want.get((r.system, r.qa_id), rk))
                assert {(r.system, r.qa_id): r.rk for r in got if r.retriever == name and r[flag]} == want
                found += len(want)
        assert found > 5


@pytest.mark.parametrize("name", ["rcps_lexical_grid", "rcps_by_difficulty", "protocol_ablation"])
def test_all_questions(spark, tmp_path, name):
    """F9 to F11: the ids of these documents are no multiples of 50, so all questions were left out."""
    text = "\n".join
    rows = [(i, text([f"alpha{i} beta gamma delta number {i} of all these lines", f"epsilon zeta eta{i} theta stands on line two of page {i}", "a line that every page has, so it tells nothing"]), "en", "src1") for i in range(1, 25)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())
    assert len(got) == (9 if name == "rcps_by_difficulty" else 3) and any(v > 0 for r in got for v in r if isinstance(v, float))


def test_search_of_files(spark, tmp_path, monkeypatch):
    """what the grid of blocks gives, with copies and ties by id, and no vector in an exchange."""
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieve, "STEP", 9)
    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(1, 9))) % 40)
    docs = spark.createDataFrame([(f"{i}#0", text()) for i in range(150)] + [(f"copy{i}", "w1 w2") for i in range(20)], "chunk_id string, text string").repartition(3)
    asks = spark.createDataFrame([(i, text()) for i in range(30)] + [(77, "w1 w2"), (78, "…"), (79, None)], "qa_id long, question string")
    encoder = retrieve.hashed_encoder()
    retrieve.index(docs, encoder).select("chunk_id", "embedding").write.parquet(base := f"file://{tmp_path}/index")
    got = retrieve.search_files(asks, base, encoder, 5)
    want = retrieve.search(asks, spark.read.parquet(base), encoder, 5)
    rows = lambda d: sorted((r.qa_id, r.rk, r.chunk_id, r.score) for r in d.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 32 * 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and "CoGroup" not in plan and "Window" not in plan


def test_all_questions_are_searched(spark, tmp_path):
    """F8: the ids of these documents are no multiples of 50."""
    rows = [(i, f"alpha{i} beta gamma number {i} of all the lines that stand here\nand a second line {i * i} of page {i} that is long enough", "en", "src1") for i in range(1, 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["encoded_search"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(catalog.ORACLE_SQL["encoded_search"])
    assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall()) and len(got) == 55


def test_clarity_of_many(spark, monkeypatch):
    """characters are counted for many texts at once, and neighbours need no exchange; values are those of the loop."""
    texts = ["aab", "", None, "한국어 ß 😀 a", "zzzz" * 30, "ab" * 400, "x"]
    pairs = [(y, x) for y in texts for x in texts]
    for cells in (1 << 20, 40):
        monkeypatch.setattr(hooks, "_CELLS", cells)
        plain, given = hooks.unigram_nlls([y for y, _ in pairs], [x for _, x in pairs])
        for (y, x), a, b in zip(pairs, plain, given):
            want = [None, None] if y is None else [hooks.unigram_nll(y, None), hooks.unigram_nll(y, x)]
            assert [None if np.isnan(v) else pytest.approx(v, abs=1e-12) for v in (a, b)] == want
    paragraph = lambda i, j: f"paragraph {i} {j} of some length, long enough to stand"
    pages = spark.createDataFrame([(i, "\n\n".join(paragraph(i, j) for j in range(i % 5))) for i in range(20)] + [(30, None), (31, "short")], "page_id long, markdown string")
    near = chunk.neighbours(pages, chunk.native_pieces(F.col("markdown"), 30))
    rows = lambda d: sorted(map(tuple, d.select("page_id", "pos", "prev_text", "next_text").collect()))
    assert rows(near) == rows(chunk.adjacent(chunk.native_chunks(pages))) and len(rows(near)) == 24
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    scores = hooks.boundary_clarity(near)
    assert hooks.large_summary(scores).first().asDict() == pytest.approx(hooks.summary(scores).first().asDict())
    none = hooks.large_summary(scores.where("false")).first()
    assert none.n == 0 and none.median is None


def test_documents_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """names of files stay out of the driver; folders of any depth, hidden names and other endings as before."""
    for name in ("a/x.pdf", "a/b/c/y z%20.pdf", "a/b/other.txt", "top.pdf", ".hidden/no.pdf", "_made/no.pdf", "a/.no.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("t")
    (tmp_path / "empty").mkdir()
    root = f"file://{tmp_path}"
    rows = lambda: sorted(map(tuple, corpus.document_index(spark, root, ".pdf").select("name", "path").collect()))
    with monkeypatch.context() as m:
        m.setattr(corpus, "_arrow_reads", lambda *_: False)
        want = rows()
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(len(data)) or create(self, data, *a, **k))
    assert rows() == want == sorted([("x", f"{root}/a/x.pdf"), ("y z%20", f"{root}/a/b/c/y z%20.pdf"), ("top", f"{root}/top.pdf")])
    assert made == [1]
