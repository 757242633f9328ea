"""Matching of whole texts against plain versions: spans, matching blocks, edit distance, coverage of packs of questions."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.functions import matching
from lectern.functions import text as tx
from lectern.operators import chunk, coverage


def pairs(seed, n, longest):
    rng = random.Random(seed)
    for i in range(n):
        letters = "ab" if i % 3 == 0 else "abcdefgh é한😀"
        a = [rng.choice(letters) for _ in range(rng.randrange(longest))]
        b = list(a) if i % 2 else [rng.choice(letters) for _ in range(rng.randrange(longest))]
        for _ in range(rng.randrange(6) if b else 0):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(3)] = rng.choice(letters) * rng.randrange(3)
            b = b or ["x"]
        yield "".join(a), "".join(b)


@pytest.mark.parametrize("small", [2_000, 6])
def test_matching_ratio(monkeypatch, small):
    """Ten thousand pairs, found by automata and by hashes of windows."""
    monkeypatch.setattr(matching, "SMALL", small)
    for a, b in pairs(small, 5_000, 50):
        want = SequenceMatcher(None, a, b, autojunk=False)
        assert matching.matching_ratio(a, b) == want.ratio(), (a, b)
        assert matching.matching_ratio(b, a) == SequenceMatcher(None, b, a, autojunk=False).ratio()


def test_matching_blocks_are_the_first_longest():
    for a, b in pairs(4, 500, 40):
        want = [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
        joined = []
        for i, j, n in matching.matching_blocks(a, b):  # neighbours are one there
            if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
                joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
            else:
                joined.append((i, j, n))
        assert joined == want


def test_matching_ratio_of_long_texts():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghij \n") for _ in range(300_000))
    b = a[:100_000] + "x" * 50 + a[100_050:250_000] + a[260_000:]
    began = time.time()
    got = matching.matching_ratio(a, b)
    assert time.time() - began < 60
    assert got == pytest.approx(2 * (len(a) - 50 - 10_000) / (len(a) + len(b)), abs=1e-4)
    assert matching.matching_ratio("", "") == 1.0 and matching.matching_ratio("a", "") == 0.0 and matching.matching_ratio(None, "a") is None


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("near", [512, 0])
def test_edit_distance(monkeypatch, near):
    """Along diagonals and by bits."""
    monkeypatch.setattr(matching, "NEAR", near)
    for a, b in pairs(near, 1_500, 80):
        assert matching.edit_distance(a, b) == plain_distance(a, b) == matching.edit_distance(b, a), (a, b)


def test_edit_distance_of_long_pages(spark, monkeypatch):
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefghij ") for _ in range(100_000))
    at = sorted(rng.sample(range(100_000), 200))
    b = "".join("#" if i in set(at) else c for i, c in enumerate(a))
    assert matching.edit_distance(a, b) == 200
    rows = [(1, a[:3000], b[100:3000]), (2, "", "abc"), (3, None, "x"), (4, "é" * 2500, "é" * 2400 + "x"), (5, "kitten", "sitting")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    want = [r[0] for r in df.select(F.levenshtein("a", "b")).collect()]
    assert [r[0] for r in df.select(matching.levenshtein(F.col("a"), F.col("b"))).collect()] == want
    assert df.where("i = 2").select(tx.text_ned(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_spans_within(spark):
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(60)))
        spans = ["".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(20))] + [None, text]
        assert matching.spans_within(text, spans) == [s is not None and s in text for s in spans]
    rows = [(1, "abcabd", ["bca", "x", ""]), (2, "abcabd", [c * (i % 2 + 1) for i, c in enumerate("abcdefghijk")]), (3, None, ["a"]), (4, None, ["a"] * 20), (5, "a", []), (6, "a", None)]
    df = spark.createDataFrame(rows, "i int, t string, s array<string>")
    got = {r.i: r.f for r in df.select("i", matching.found_in(F.col("t"), F.col("s")).alias("f")).collect()}
    assert got == {i: None if s is None else [t is not None and x in t for x in s] for i, t, s in rows}


def test_many_questions_of_one_page(spark, monkeypatch):
    """A page with many questions in several packs, repeated and null questions, pages that are missing, empty or null."""
    monkeypatch.setattr(coverage, "PACK", 7)
    page = "First part of the text.\n\nSecond part | with *marks*.\n\nThird."
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, markdown string")
    spans = ["first part", "PART OF", "text. Second", "marks", "absent", "", None, "third.", "withmarks"]
    rows = [(i, p, spans[i % len(spans)], "x") for p in (1, 2, 3, 4, None) for i in range(60)]
    qa = spark.createDataFrame(rows + rows[:5], "qa_id long, page_id long, answer_span string, q string")
    got = coverage.classify_pieces(qa, pages, chunk.native_pieces(F.col("markdown"), 5))
    assert got.columns == [*qa.columns, "location"]
    norm = lambda t: "".join(c for c in t.lower() if c not in "|*#`>~_ \n")
    chunks = [norm(c) for c in page.split("\n\n")]

    def place(p, s):
        if p in (2, 4, None):
            return "no_parse"
        if not s or p == 3:
            return "absent"
        return "covered" if any(norm(s) in c for c in chunks) else "split" if norm(s) in norm(page) else "absent"

    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*r, place(r[1], r[2])) for r in rows + rows[:5]), key=repr)


def test_ladder_of_packs_is_the_ladder(spark):
    """Each rung in a page's row gives what the matcher of that name gives for one question and one page."""
    pages = [(1, "The Ｔotal was 1,234.50 Euro in MÜNCHEN on 3 May.", "a"), (1, "total was 1234.50", "b"), (2, "| cell | two |", "a"), (3, None, "a")]
    spans = ["total was", "1234.50", "1,234.50 euro", "München", "in 3 May Total", "cell two", "cel1 two", "", None, "zzz", "Ｔotal", "was 1234.5O"]
    qa = spark.createDataFrame([(i * 10 + p, p, s, "t") for p in (1, 2, 3, 9) for i, s in enumerate(spans)], "qa_id long, page_id long, answer_span string, kind string")
    df = spark.createDataFrame(pages, "page_id long, markdown string, parser string")
    for exact in (True, False):
        got = {(r.qa_id, r.parser): tuple(r.answer) for r in coverage.present(qa, df, exact_unicode=exact, within=("parser",)).collect()}
        extra = lambda n: {} if n in ("L0_exact", "L4_fuzzy_lcs") else {"exact_unicode": exact}
        both = qa.join(df, "page_id", "left")
        flags = [F.coalesce(f(F.col("answer_span"), F.col("markdown"), **extra(n)), F.lit(False)) for n, f in coverage.LADDER.items()]
        want = {(r[0], r[1]): tuple(r)[2:] for r in both.select("qa_id", "parser", *flags).collect()}
        assert got == want
