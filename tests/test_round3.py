"""Steps that must stay whole on larger tables: each against a plain version."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.text import TOKEN
from lectern.operators import chunk, resample, retrieve
from lectern.plans import catalog


@pytest.mark.parametrize("step", [1 << 20, 40])
def test_lexical_best(spark, monkeypatch, step):
    """Scores of the grid are those of the joins, for all three scorers, with copies, words of nearly all documents, and texts without terms."""
    rng = np.random.default_rng(3)
    text = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 60]
    rows = [(s, f"{i}#{s}", text(int(rng.integers(0, 30)))) for s in "ab" for i in range(60)] + [("a", f"copy{i}", ["w1", "w2", "w3"]) for i in range(40)] + [("b", "none", [])]
    docs = spark.createDataFrame(rows, "system string, chunk_id string, terms array<string>")
    asked = spark.createDataFrame([(i, text(8)) for i in range(12)] + [(90, ["w1", "w2", "w3", "w1"]), (91, ["unknown"]), (92, []), (93, None)], "qa_id long, terms array<string>")
    monkeypatch.setattr(retrieve, "TERMS_STEP", step)
    top = lambda s: {(r.system, r.qa_id, r.rk): (r.chunk_id, r.score) for r in retrieve.top_k(s, 5, ("system", "qa_id")).collect()}
    words = retrieve.asked_terms(asked)
    pairs = retrieve.asked_terms(asked.withColumn("terms", retrieve.word_pairs(F.col("terms"))))
    want = {
        "bm25": retrieve.bm25_scores(words, docs, ("system",)),
        "jaccard": retrieve.jaccard_scores(words, docs, ("system",)),
        "pairs": retrieve.cosine_scores(pairs, docs.withColumn("terms", retrieve.word_pairs(F.col("terms"))), ("system",)),
    }
    got = retrieve.lexical_best(asked, docs, 5, ("system",)).cache()
    for name, scores in want.items():
        assert top(scores) == top(got.where(F.col("retriever") == name))


def _md5_head(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_bootstraps(spark, monkeypatch):
    """Draws over several pieces and blocks, nulls among the values, against a loop; no draw is a row of an exchange."""
    monkeypatch.setattr(resample, "PIECE", 50)
    monkeypatch.setattr(resample, "BLOCK", 32)
    values = [None if i % 11 == 0 else i * 0.5 - 30 for i in range(170)]
    rows = spark.createDataFrame([(i + 5, v) for i, v in enumerate(values)], "k long, v double")
    drawn = [[values[_md5_head(f"{rep}-{j}") % 170] for j in range(170)] for rep in range(9)]
    means = [np.mean([v for v in d if v is not None]) for d in drawn]
    out = resample.hashed_bootstrap(rows, "v", "k", 9)
    got = out.first()
    assert got.n == 170 and got.mean == pytest.approx(np.mean([v for v in values if v is not None]))
    assert (got.low, got.high, got.p_positive) == pytest.approx((*np.percentile(means, [2.5, 97.5]), np.mean(np.array(means) > 0)))
    assert "offsets" in out._jdf.queryExecution().toString()
    weights = [[next((k for k, x in enumerate(resample.POISSON) if _md5_head(f"{rep}-{i + 5}") / 2**32 < x), 8) for i in range(170)] for rep in range(9)]
    means = [sum(w * v for w, v in zip(ws, values) if v is not None) / sum(ws) for ws in weights]
    got = resample.poisson_bootstrap(rows, "v", "k", 9).first()
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_long_page_numbers(spark, tmp_path):
    """The query's SQL pads keys to four characters, and so cuts longer numbers."""
    spark.createDataFrame([(7,), (9999,), (10001,), (123456,)], "page_id long").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(catalog.ORACLE_SQL["path_ids"])
    got = catalog.QUERIES["path_ids"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_topics_in_slices(spark, monkeypatch):
    """A task turns few pages into Python lists at a time; rows, order and other columns stay."""
    monkeypatch.setattr(chunk, "PAGES_STEP", 3)
    pages = [(i, f"x{i}", None if i % 9 == 0 else "\n".join(f"s{j} {'same' if (i + j) % 3 else 'other'}" for j in range(i % 7))) for i in range(40)]
    rows = chunk.topic_chunks(spark.createDataFrame(pages, "page_id long, kept string, markdown string").coalesce(1), window=4)
    got = {}
    for r in rows.orderBy("page_id", "pos").collect():
        assert r.kept == f"x{r.page_id}" and r.chunk_id == f"{r.page_id}::lumberchunker#{r.pos}"
        got.setdefault(r.page_id, []).append(r.text)
    assert {p: "\n".join(t) for p, t in got.items()} == {i: t for i, _, t in pages if t}
    assert "pandas" not in rows._jdf.queryExecution().toString().lower()


def test_encoder(spark):
    """Counts of tokens by their md5, of length 1; a text without tokens is 0."""
    texts = ["Alpha beta alpha", "", "한국어 text 12", None, "…"]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", retrieve.hashed_encoder()(F.col("t")).alias("e"))
    for r in got.collect():
        if texts[r.i] is None:
            assert r.e is None
            continue
        want = np.bincount([_md5_head(x) % 64 for x in re.findall(TOKEN, texts[r.i].lower())], minlength=64).astype(float)
        assert r.e == list(want / max(np.sqrt((want * want).sum()), 1e-12))
    assert "lambda" not in got._jdf.queryExecution().toString().lower()
