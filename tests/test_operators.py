"""Literal cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import statistics as st, text as tx, vectors as vx
from lectern.operators import chunk, coverage, gates, metrics, prefer, resample, retrieve, sample
from lectern.sources import corpus, sinks
from lectern.streaming import incremental


def pages(spark, *texts):
    return spark.createDataFrame([(f"p{i + 1}", t) for i, t in enumerate(texts)], "page_id string, markdown string")


def pieces(df):
    return [r.text for r in df.orderBy("page_id", "pos").collect()]


def test_fixed_windows(spark):
    assert pieces(chunk.fixed_chunks(pages(spark, "", "   ", None))) == []
    rows = chunk.fixed_chunks(pages(spark, "a" * 130), 50).collect()
    assert len(rows) >= 2 and rows[0].chunk_id == "p1::fixed50#0"
    assert pieces(chunk.fixed_chunks(pages(spark, "short text"), 100)) == ["short text"]
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunk.fixed_chunks(pages(spark, "x"), size, overlap)
    text = "머리말 " + "가" * 470 + " 경계답 " + "나" * 470 + " 끝답 여기"
    joined = pieces(chunk.fixed_chunks(pages(spark, text), 500, 200))
    assert len(joined) >= 2 and any("경계답" in p for p in joined) and any("끝답" in p for p in joined)


def test_headers(spark):
    text = "# Title\nbody A\n## Sub\nbody B\n# Title 2\nbody C"
    assert len(pieces(chunk.header_chunks(pages(spark, text), 2))) == 3
    assert pieces(chunk.header_chunks(pages(spark, "intro\n# T\nbody"), 2)) == ["intro", "# T\nbody"]
    assert len(pieces(chunk.header_chunks(pages(spark, "# A\nx\n### deep\ny\n# B\nz"), 2))) == 2
    assert pieces(chunk.header_chunks(pages(spark, "no header"), 2)) == ["no header"]


def test_native(spark):
    text = "first para\n\nmid\n\nthird paragraph"
    assert len(pieces(chunk.native_chunks(pages(spark, text), 3))) == 3
    assert len(pieces(chunk.native_chunks(pages(spark, text), 8))) == 2
    assert pieces(chunk.native_chunks(pages(spark, text), 100)) == [text]


def test_topic_chunks_cap(spark):
    lines = "\n".join(f"same word {i}" for i in range(30))
    got = pieces(chunk.topic_chunks(pages(spark, lines), boundary=lambda s, a, b: None, window=20, max_segments=12))
    assert [len(p.split("\n")) for p in got] == [12, 12, 6]


def test_midpoint(spark):
    df = spark.createDataFrame([("a" * 30 + " " + "b" * 30,), ("short",), (None,)], "text string")
    got = [r.s for r in df.select(chunk.midpoint_split(F.col("text")).alias("s")).collect()]
    assert (got[0].head, got[0].tail) == ("a" * 30, "b" * 30) and got[1].head is None and got[2].head is None


def test_metrics(spark):
    hits = spark.createDataFrame([("a", 2), ("b", None)], "qa_id string, pos int")
    got = {(r.qa_id, r.k): r for r in metrics.cube(hits).collect()}
    assert got["a", 1].mrr == 0 and got["a", 5].mrr == 0.5 and got["a", 10].hit == 1 and got["a", 1].ndcg == 0
    assert got["a", 5].ndcg == pytest.approx(1 / math.log2(3)) and got["b", 10].mrr == 0


def test_coverage(spark):
    qa = spark.createDataFrame([("1", "p1", "CD"), ("2", "p1", "XYZ"), ("3", "p9", "AB"), ("4", "p1", "   "), ("5", "p2", "| **Seoul** |")], "qa_id string, page_id string, answer_span string")
    pg = spark.createDataFrame([("p1", "ABCDEF"), ("p2", "| **Seoul** | capital |"), ("p9", None)], "page_id string, markdown string")
    ck = spark.createDataFrame([("p1", "ABC"), ("p1", "DEF"), ("p2", "| **Seoul** | capital |")], "page_id string, text string")
    got = {r.qa_id: r.location for r in coverage.classify(qa, pg, ck).collect()}
    assert got == {"1": "split", "2": "absent", "3": "no_parse", "4": "absent", "5": "covered"}


def _ladder(spark, answer, page):
    df = spark.createDataFrame([(answer, page)], "a string, p string")
    return [df.select(f(F.col("a"), F.col("p"))).first()[0] for f in coverage.LADDER.values()]


def test_ladder(spark):
    assert _ladder(spark, "**Total: 42**", "the total   :42 here")[:2] == [False, True]
    assert _ladder(spark, "1,234,567", "is 1234567 won")[1:3] == [False, True]
    assert _ladder(spark, "alpha beta gamma", "gamma then beta then alpha")[3]
    assert _ladder(spark, "abcdefghij", "xx abcdefghiX yy")[4]
    assert not any(_ladder(spark, "", "anything"))


def test_longest_common_substring():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 14))) for _ in range(2))
        plain = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)
        assert tx.longest_common(a, b) == plain


def test_normalisation(spark):
    df = spark.createDataFrame([("ＡＢＣ | **x** ﬁ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tx.normalize_for_match(F.col("t"))).collect()] == ["abcxfi", None, ""]
    assert df.select(tx.text_ned(F.lit(""), F.lit("")).alias("n")).first().n == 0


def test_correlation_p():
    assert st.p_of_r(-0.8137, 5) == pytest.approx(0.0938, abs=2e-4)
    assert st.p_of_r(-0.7, 5) == pytest.approx(0.1881, abs=2e-4)
    assert math.isnan(st.p_of_r(0.5, 2)) and st.p_of_r(1.0, 5) == 0


def test_pearson_of_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert math.isnan(df.agg(st.pearson("x", "y")).first()[0])


def test_average_ranks(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (30.0,)], "v double")
    assert sorted(r.r for r in resample.average_ranks(df, "v", "r").collect()) == [1, 2.5, 2.5, 4]


def test_exact_bootstrap(spark):
    values = np.random.default_rng(3).normal(size=40)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)], "g string, i int, v double")
    got = resample.exact_bootstrap(df, ("g",), "v", "i", 500).first()
    means = values[np.random.default_rng(42).integers(0, 40, size=(500, 40))].mean(axis=1)
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_losses(spark):
    df = spark.createDataFrame([(1.0, [0.0] * 7)], "p double, n array<double>")
    assert df.select(vx.info_nce(F.col("p"), F.col("n"))).first()[0] < 0.1
    assert spark.range(1).select(vx.info_nce(F.lit(0.0), F.array(*[F.lit(0.0)] * 7), 1.0)).first()[0] == pytest.approx(math.log(8))
    assert spark.range(1).select(vx.dpo_loss(F.lit(0.0))).first()[0] == pytest.approx(math.log(2))
    assert spark.range(1).select(vx.total_loss(F.lit(0.4), F.lit(9.0), 0.0)).first()[0] == 0.4


def test_dense_scores_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id int, embedding array<double>")
    q = df.where("chunk_id < 7").select(F.col("chunk_id").alias("qa_id"), "embedding")
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    got = {(r.qa_id, r.rk): r.chunk_id for r in retrieve.top_k(retrieve.dense_scores(q, df, 5), 5).collect()}
    for i in range(7):
        order = sorted(range(30), key=lambda j: (-round(float(v[i] @ v[j]), 6), j))[:5]
        assert [got[i, k + 1] for k in range(5)] == order


def test_nearest_of_others_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(60, 4)).round(1), np.ones((20, 4))])
    own = [i % 5 for i in range(80)]
    df = spark.createDataFrame([(i, own[i], [float(x) for x in r]) for i, r in enumerate(v)], "item long, owner long, vector array<float>").repartition(3)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 7)
    got = prefer.hard_negatives(retrieve.nearest_of_others(df.where("item % 2 = 0").withColumnRenamed("owner", "page"), df, 6), 6, "page", "item").collect()
    sims = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 6)
    for page in range(5):
        best = {i: max(sims[q, i] for q in range(0, 80, 2) if own[q] == page) for i in range(80) if own[i] != page}
        want = sorted(best, key=lambda i: (-best[i], i))[:6]
        assert [r.item for r in sorted((r for r in got if r.page == page), key=lambda r: r.rk)] == want


def test_hard_negatives_ask_all_queries(spark, tmp_path):
    from lectern.plans import preference

    n = 50 * ((1 << 16) + 2)  # more queries than 65,536; the last alone is near vector 1
    rows = spark.range(0, n, 50, 1).select(F.col("id").alias("vec_id"), F.when(F.col("id") == n - 50, 1).otherwise(0).alias("label"), F.array(*[F.when(F.col("id") == n - 50, float(i)).otherwise(float(1 - i)).cast("float") for i in range(2)]).alias("embedding"))
    rows.union(spark.sql("SELECT 1L, 0, array(float(0), float(1))")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.page, r.rk): (r.vec_id, r.sim) for r in preference.hard_negatives(spark, str(tmp_path)).collect()}
    assert got[1, 1] == (1, 1.0) and got[0, 1] == (n - 50, 0.0)


def test_best_and_worst_ties(spark):
    df = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 0.9), ("p", 2, 0.9), ("p", 3, 0.5), ("q", 0, 1.0), ("r", 0, 0.1), ("r", 1, 0.15)], "page_id string, candidate_idx int, score double")
    got = prefer.best_and_worst(df, 0.2).collect()
    assert [(r.page_id, r.chosen, r.rejected) for r in got] == [("p", 1, 3)]


def test_distractors_and_negatives(spark):
    chunks = spark.createDataFrame([(f"p{i % 5}", f"c{i:02d}") for i in range(60)], "page_id string, chunk_id string")
    pg = chunks.select("page_id").distinct()
    a = prefer.distractors(pg, chunks, 6).collect()
    owner = {r.chunk_id: r.page_id for r in chunks.collect()}
    assert a and all(owner[r.chunk_id] != r.page_id for r in a) and sorted(a) == sorted(prefer.distractors(pg.repartition(3), chunks.repartition(7), 6).collect())
    anchors = spark.createDataFrame([("q", "p0", "c00")], "qa_id string, page_id string, chunk_id string")
    got = prefer.sampled_negatives(anchors, chunks, 20).collect()
    assert len(got) == 20 and all(owner[r.chunk_id] == "p0" and r.chunk_id != "c00" for r in got)


def test_distractors_are_whole(spark):
    import hashlib

    # p0 owns nearly all of 600 chunks, p9 none: both get as many as there are, at most n
    own = {f"c{i:03d}": "p0" if i % 20 else f"p{1 + i // 20 % 8}" for i in range(600)}
    chunks = spark.createDataFrame([(p, c) for c, p in own.items()], "page_id string, chunk_id string")
    pg = spark.createDataFrame([(f"p{i}",) for i in range(10)], "page_id string")
    md5 = lambda x: hashlib.md5(f"{x}-42".encode()).hexdigest()
    for n in (5, 25, 100, 1000):
        cells = max(1, 600 // n)
        cell = lambda x: int(md5(x)[:8], 16) % cells  # noqa: E731, B023
        got = prefer.distractors(pg, chunks, n).collect()
        for p in (f"p{i}" for i in range(10)):
            want = sorted((c for c in own if own[c] != p), key=lambda c: ((cell(c) - cell(p)) % cells, md5(c), c))[:n]
            assert [r.chunk_id for r in sorted(got, key=lambda r: r.rk) if r.page_id == p] == want and len(want) == min(n, sum(o != p for o in own.values()))


def test_split_is_half_even(spark):
    df = spark.range(5).select(F.col("id").alias("k"), F.lit("s").alias("s"))
    assert sample.stratified_split(df, "k", ("s",), 0.5).where("fold = 'train'").count() == 2


def test_gates(spark):
    qa = spark.createDataFrame([("q1", "a"), ("q2", "m"), ("q3", "m")], "qa_id string, page_id string")
    have = spark.createDataFrame([("a", "")], "page_id string, markdown string")
    with pytest.raises(gates.GateError, match="missing 1/2 evidence pages, affecting 2/3 Q-A"):
        gates.require_coverage(qa, have, "page_id", "x")
    with pytest.raises(gates.GateError):
        gates.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    with pytest.raises(gates.GateError):
        gates.require_output_name("out/report.json")
    assert gates.require_output_name("out/strict_report.json")
    with pytest.raises(gates.GateError):
        gates.require_finite(spark.createDataFrame([(float("nan"),)], "x double"), "x")


def test_sources(spark, tmp_path):
    lines = '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"gt"}],"images":["/x/documents/doc1/page_0001.png"]}'
    (tmp_path / "val.jsonl").write_text(lines + "\n\n" + lines + "\n")
    got = corpus.page_index(spark, str(tmp_path / "val.jsonl")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [("val_0000", "doc1_page_0001"), ("val_0002", "doc1_page_0001")]
    assert corpus.ground_truth(spark, str(tmp_path / "val.jsonl")).first().markdown == "gt"
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "doc1_page_0001.md").write_text("")
    out = corpus.parser_output(spark, str(tmp_path / "md"), corpus.page_index(spark, str(tmp_path / "val.jsonl")), "p").collect()
    assert {r.markdown for r in out} == {""} and len(out) == 2
    (tmp_path / "qa.jsonl").write_text('{"qa_id":"1","page_id":"p","question_type":"factoid","difficulty":"easy"}\n\n')
    row = corpus.read_qa(spark, str(tmp_path / "qa.jsonl")).first()
    assert row.multi_page is False and row.referenced_pages == []


def test_parallel_arrays(spark):
    df = spark.createDataFrame([("law", ("i", ["q1", "q2"]))], "domain string, x struct<a:string,questions:array<string>>")
    rows = df.select("domain", F.struct(F.array(F.lit("1"), F.lit("2")).alias("ID"), F.col("x.questions").alias("questions"), F.array(F.lit("a"), F.lit("b")).alias("answers"), F.array(F.lit("n/d"), F.lit("n/e")).alias("doc_name"), F.array(F.lit(0), F.lit(3)).alias("evidence_page_no"), F.array(F.lit("law"), F.lit("law")).alias("doc_type")).alias("qas"))
    assert [r.page_id for r in corpus.flat_questions(rows).collect()] == ["d__p0", "e__p3"]


def test_store_is_bound(spark, tmp_path):
    store = f"file://{tmp_path}/s"
    incremental.bind(spark, store, {"v": 1})
    incremental.bind(spark, store, {"v": 1})
    with pytest.raises(gates.GateError):
        incremental.bind(spark, store, {"v": 2})


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, None)], "name string, v double, w string")
    assert sinks.markdown_table(df).split("\n")[2] == "| a | 0.5000 |  |"
    for text in ("x", "y é"):
        sinks.publish(spark, f"file://{tmp_path}/r.md", text)
        assert (tmp_path / "r.md").read_text() == text
    with pytest.raises(ValueError):
        sinks.report_json({"x": float("nan")})
    with pytest.raises(gates.GateError):
        sinks.markdown_table(spark.range(5).toDF("n"), limit=4)
    rates = spark.createDataFrame([("a", 10, 0.5, 0.25, 0.25), ("b", 10, 0.75, 0.125, 0.125)], "system string, total long, coverage double, split_rate double, parser_fault double")
    assert sinks.coverage_report(rates).split("\n")[2] == "| b | 10 | 75.0 % | 12.5 % | 12.5 % |"
    ladder = spark.createDataFrame([("a", "L0", 0.5), ("b", "L0", 0.25)], "system string, rung string, absent double")
    assert sinks.ladder_report(ladder, "a").split("\n")[3] == "| b | 25.0 (-25.0) |"
    sheet = sinks.review_sheet(spark.createDataFrame([(1, "<b>", bytearray(b"png"))], "slot int, answer string, image binary"), "Sheet", ("answer",), "image").first().value
    assert "&lt;b&gt;" in sheet and "base64,cG5n" in sheet


def test_missing_pages_and_parts(spark, tmp_path):
    for part, name, text in (("a", "p1", "one"), ("b", "p2", "two"), ("b", "p3 +é", "")):
        (tmp_path / part).mkdir(exist_ok=True)
        (tmp_path / part / f"{name}.md").write_text(text)
    got = {r.page_id: r.markdown for r in corpus.parsed_pages(spark, str(tmp_path)).collect()}
    assert got == {"p1": "one", "p2": "two", "p3 +é": ""}
    allowed = spark.createDataFrame([("p2",)], "page_id string")
    assert [r.page_id for r in corpus.parsed_pages(spark, str(tmp_path), allowed).collect()] == ["p2"]
    (tmp_path / "a" / "p2.md").write_text("again")
    with pytest.raises(gates.GateError):
        corpus.parsed_pages(spark, str(tmp_path))
    with pytest.raises(gates.GateError):
        corpus.parser_output(spark, f"{tmp_path}/a", spark.createDataFrame([("x", "nowhere")], "page_id string, stem string"), "p", strict=True)


def test_documents_of_one_name(spark, tmp_path):
    for part in "ab":
        (tmp_path / part).mkdir()
        (tmp_path / part / "doc.pdf").write_text("x")
    with pytest.raises(gates.GateError):
        corpus.document_index(spark, str(tmp_path), ".pdf")


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": [1, 2]}')
    assert corpus.read_config(str(tmp_path / "c.json")) == {"a": [1, 2]}


def test_gates_on_numbers(spark):
    df = spark.range(6).withColumn("v", F.col("id") / 10)
    gates.require_counts(df, rows=6, id=6)
    with pytest.raises(gates.GateError):
        gates.require_counts(df, rows=5)
    gates.require_status("ok", ("ok", "partial"))
    with pytest.raises(gates.GateError):
        gates.require_status("bad", ("ok",))
    assert gates.mean_gap_gate(df, "v", 0.5) and not gates.mean_gap_gate(df, "v", 0.6) and not gates.mean_gap_gate(df.where("id < 0"), "v", 0.0)
    assert [r.id for r in sample.first_rows(df, "id", 2).collect()] == [0, 1]
    answers = spark.createDataFrame([("x",)] * 8 + [("",), (None,)], "pred string")
    gates.require_answers(answers, least=0.8)
    with pytest.raises(gates.GateError):
        gates.require_answers(answers)


def test_gates_on_paths(spark, tmp_path):
    (tmp_path / "there").write_text("x")
    gates.require_files(spark, f"file://{tmp_path}/there")
    with pytest.raises(gates.GateError):
        gates.require_files(spark, f"file://{tmp_path}/there", f"file://{tmp_path}/gone")
    assert gates.require_cache_path("file:///c/x/y", "file:///c/x") == "file:///c/x/y"
    for bad in ("file:///c/x/../y", "file:///c/xy", "file:///d"):
        with pytest.raises(gates.GateError):
            gates.require_cache_path(bad, "file:///c/x")
    assert incremental.wait_for(spark, f"file://{tmp_path}/*", 1, 0.01) == 1
    with pytest.raises(gates.GateError):
        incremental.wait_for(spark, f"file://{tmp_path}/*.none", 1, 0.002, 0.01)


def test_completions(spark):
    from lectern.operators import hooks

    def make():
        seen = {}

        def ask(prompts):
            out = []
            for p in prompts:
                seen[p] = seen.get(p, 0) + 1
                out.append(None if p == "never" else "" if p == "late" and seen[p] < 2 else p.upper())
            return out

        return ask

    df = spark.createDataFrame([("a",), ("late",), ("never",)], "prompt string")
    assert {r.prompt: r.reply for r in hooks.completed(df, make, parallel=1).collect()} == {"a": "A", "late": "LATE", "never": None}


def test_judging(spark):
    from lectern.operators import judge

    df = spark.createDataFrame([('{"ok": true, "n": 1}',), ('{"ok": true}',), ('{"ok": "x", "n": 1}',), ('{"ok": true, "n": 1, "z": 2}',), ("[]",), (None,)], "t string")
    got = [r.v for r in df.select(judge.strict_reply(F.col("t"), {"ok": "boolean", "n": "int"}).alias("v")).collect()]
    assert got[0].ok is True and got[0].n == 1 and got[1:] == [None] * 5


def test_degenerate_statistics(spark):
    one = spark.range(1)
    low, high = st.wilson(F.lit(0), F.lit(3), 1.96, clamp=False)
    assert one.select(low.alias("a")).first().a == pytest.approx(0, abs=1e-12) and one.select(high.alias("b")).first().b < 1
    assert math.isnan(one.select(st.kappa(F.lit(1.0), F.lit(1.0)).alias("k")).first().k)
    empty = spark.createDataFrame([], "retriever string, k int, mrr double, hit double")
    assert metrics.rcps(empty).first().rcps == 0.0
    ranked = metrics.ranking(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "name string, s double"), "name", "s", fixed=("b", "a"))
    assert {r.name: r.rk for r in ranked.collect()} == {"b": 1, "a": 2}


def test_numbers_without_a_window_over_all(spark):
    rng = np.random.default_rng(5)
    values = [float(x) for x in rng.choice([0.0, 1.0, 2.5, -3.0, 1e6], 300)] + [float(x) for x in rng.normal(size=200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    got = {r.k: r.i for r in resample.numbered(df, "v", "k").collect()}
    assert got == {k: n for n, k in enumerate(sorted(range(500), key=lambda k: (values[k], k)))}
    ranks = {r.k: r.r for r in resample.average_ranks(df, "v", "r").collect()}
    assert all(r == sum(x < values[k] for x in values) + (sum(x == values[k] for x in values) + 1) / 2 for k, r in ranks.items())


def test_poisson_bootstrap(spark):
    values = np.random.default_rng(3).normal(1, 2, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k int, v double")
    got = resample.poisson_bootstrap(df, "v", "k", 400).first()
    wide = 1.96 * values.std() / 20
    assert got.mean == pytest.approx(values.mean()) and got.low == pytest.approx(values.mean() - wide, abs=0.08) and got.high == pytest.approx(values.mean() + wide, abs=0.08)


def test_projection_head(spark):
    rng = np.random.default_rng(6)
    w1, b1, w2, b2, x = rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=(3, 4)), rng.normal(size=3), rng.normal(size=(5, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, x array<double>")
    got = [r.y for r in df.select("i", vx.projection_head(w1, b1, w2, b2, np.ones(3), np.zeros(3))("x").alias("y")).orderBy("i").collect()]
    for row, y in zip(x, got):
        h = w1 @ row + b1
        h = np.array([v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in h])
        z = w2 @ h + b2
        z = (z - z.mean()) / np.sqrt(z.var() + 1e-5)
        assert y == pytest.approx(z / np.linalg.norm(z))


def test_in_batch_negatives(spark):
    anchors = spark.createDataFrame([(f"q{i}", f"p{i % 7}", f"c{i % 7}") for i in range(60)] + [("none", "p1", None)], "qa_id string, page_id string, chunk_id string")
    got = prefer.in_batch_negatives(anchors, 10).collect()
    page = {r.qa_id: r.page_id for r in anchors.collect()}
    assert got and all(r.chunk_id != "c" + page[r.qa_id][1:] for r in got) and "none" not in {r.qa_id for r in got}


def test_tables_in_text(spark):
    rows = [("| a | b |\n|---|:-:|\n| 1 | 2 |", True), ("<TABLE class='x'><tr></tr></TABLE>", True), ("a --- b", False), ("plain", False)]
    got = [r.t for r in spark.createDataFrame(rows, "text string, want boolean").select(tx.has_table(F.col("text")).alias("t")).collect()]
    assert got == [w for _, w in rows]


def test_candidates_are_ranked_in_their_pool(spark):
    asks = spark.createDataFrame([("p", "q", 1.0)], "page_id string, qa_id string, ask double")
    own = spark.createDataFrame([("p", 0, "a", 0.5, ["q"]), ("p", 0, "b", 0.9, []), ("p", 1, "c", 0.2, []), ("p", 2, "d", 0.95, ["q"])], "page_id string, candidate int, chunk_id string, item double, relevant array<string>")
    pool = spark.createDataFrame([("p", "x", 0.7), ("p", "y", 0.1)], "page_id string, chunk_id string, item double")
    got = {r.candidate: r.rcps for r in retrieve.candidate_scores(asks, own, pool, lambda a, b: a * b).collect()}
    assert got == {0: round((0 + 1 / 3 + 1 / 3) / 3, 6), 1: 0.0, 2: 1.0}


def test_truncated_context(spark):
    df = spark.createDataFrame([(list(range(10)), list(range(100, 106))), ([], [1]), (list(range(3)), list(range(20)))], "c array<int>, t array<int>")
    context, target = vx.truncated_context(F.col("c"), F.col("t"), 8)
    got = [(r.c, r.t) for r in df.select(context.alias("c"), target.alias("t")).collect()]
    assert got == [([6, 7, 8, 9], [100, 101, 102, 103]), ([], [1]), ([0, 1, 2], [0, 1, 2, 3])]


def test_chat_client(spark, tmp_path):
    import http.server
    import json
    import threading

    from lectern.operators import hooks

    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body["messages"][-1]["content"])
            bad = body["messages"][-1]["content"] == "bad"
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b"" if bad else json.dumps({"choices": [{"message": {"content": body["model"] + ":" + body["messages"][-1]["content"]}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = hooks.chat_client(f"http://127.0.0.1:{server.server_port}/v1", "m", "be brief")
        df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "bad")], "key string, prompt string")
        for _ in range(2):
            got = {r.key: r.value for r in hooks.completed_pending(df, f"file://{tmp_path}/s", "key", client, retries=0).collect()}
            assert got == {"1": "m:a", "2": "m:b"}
        assert asked.count("a") == asked.count("b") == 1 and asked.count("bad") == 2
    finally:
        server.shutdown()


def test_parsed_by_command(spark):
    from lectern.operators import hooks

    df = spark.createDataFrame([(1, bytearray(b"<b>x</b>")), (2, None)], "k int, content binary")
    assert {r.k: r.markdown for r in hooks.parsed_by_command(df, ["cat"]).collect()} == {1: "<b>x</b>", 2: ""}
    assert {r.markdown for r in hooks.parsed_by_command(df, ["false"]).collect()} == {None}


def test_vectors_are_bound(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    incremental.save_vectors(df, f"file://{tmp_path}/v", {"m": 1})
    with pytest.raises(gates.GateError):
        incremental.load_vectors(spark, f"file://{tmp_path}/v", {"m": 2})
    with pytest.raises(gates.GateError):
        incremental.load_vectors(spark, f"file://{tmp_path}/v", {"m": 1}, spark.createDataFrame([("z",)], "chunk_id string"))
    assert incremental.load_vectors(spark, f"file://{tmp_path}/v", {"m": 1}).count() == 2
