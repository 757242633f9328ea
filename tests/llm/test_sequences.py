"""Operators 11 to 13 against plain versions, over many ranges, and on odd rows."""

import collections
import datetime
import hashlib
import os
import random
import re

import numpy as np
import pytest

from lectern.llm import alignment, queries, row_patterns, suffix_dedup, tokens

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture
def many_ranges(spark):
    """So many partitions that one client, string or pair of ids is in several."""
    keys = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# -- 11: alignment


def plain_alignment(rows, path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    tok.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    bytes_a = lambda i: bytes(of[c] for c in tok.id_to_token(i))
    bytes_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    held, held_by = [], collections.Counter()
    for _, text in rows:
        a, b = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if text and any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((bytes_a, a), (bytes_b, b))):
            a, b = [], []
        links, groups, one, two = [], [], [], []
        ends_a, ends_b = (np.cumsum([len(f(x)) for x in ids]) if ids else [] for f, ids in ((bytes_a, a), (bytes_b, b)))
        i = j = 0
        while i < len(a):
            links.append((a[i], b[j]))
            step_a, step_b = int(ends_a[i] <= ends_b[j]), int(ends_b[j] <= ends_a[i])
            one += [a[i]] * step_a
            two += [b[j]] * step_b
            if step_a and step_b:
                groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
                one, two = [], []
            i, j = i + step_a, j + step_b
        held.append((a, b, links, groups))
        held_by.update(set(links))
    most = collections.Counter()
    for (x, _), n in held_by.items():
        most[x] = max(most[x], n)
    return sorted((i, len(a), len(b), len(g), len(k), sum(held_by[x] == most[x[0]] for x in k), sum(held_by[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for (i, _), (a, b, k, g) in zip(rows, held))


def paths():
    return tokens.tokenizer_path(), tokens.tokenizer_path("piece_bpe_32k.model")


HARD = ["<|endoftext|> </s> <unk> <0x41>", "a▁b", "  leading", "trailing  ", "\n\n\ttabs\r\n", "don't we'll 1234567 ½ ﬁ", "日本語のテキスト", "😀👩‍👩‍👧 é̂", " ", "▁", "\x00\x7f", "Ünïcode straße " * 5]


def test_alignment_plain(spark, odd, empty, many_ranges):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(HARD)] + [(100, HARD[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in alignment.align(df, *paths()).collect())
    assert got == plain_alignment(rows, *paths())
    assert alignment.align(empty, *paths()).count() == 0
    assert alignment.align(odd, *paths()).columns[0] == "doc_id" and alignment.align(odd, *paths()).count() == odd.count()
    none = {r.doc_id: r for r in alignment.align(df.where("doc_id in (1, 2, 101)"), *paths()).collect()}
    assert all(r.n_a == r.n_links == r.count_sum == 0 and r.groups_sha256 == "" for r in none.values()) and len(none) == 3


def test_alignment_long_text_in_parts(spark, monkeypatch):
    """A text in parts, cut where groups end, has the numbers that it has in one."""
    a, b = (alignment.vocabulary(p) for p in paths())
    enc = [tokens.encoder(p, False) for p in paths()]
    ids = [e._long((" " + "naïve tokens, 12345 straße\n" * 400).encode()) for e in enc]
    monkeypatch.setattr(alignment, "LINKS", 64)
    parts = list(alignment._parts(a, b, *ids))
    assert len(parts) > 50 and all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts), ids))
    assert all(a.sizes[x].sum() == b.sizes[y].sum() for x, y in parts)
    whole = alignment._links(a, b, *ids)[0]
    assert (np.concatenate([alignment._links(a, b, *p)[0] for p in parts]) == whole).all()
    assert (alignment._distinct_keys(a, b, *ids, np.array([a.sizes[ids[0]].sum()])) == np.unique(whole)).all()


@needs_tables
def test_alignment_query(spark, many_ranges):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_tokenizer_alignment(spark, SF).collect()) == plain_alignment(rows, *paths())


def test_pieces_are_the_librarys():
    """Parts that begin with blanks have the ids that they have in their text."""
    import pyarrow as pa

    enc = tokens.encoder(paths()[1])
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b ", "  ", "the ", "\n", "é", "日", ".", "ing", "🙂", "▁"]) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for ids, offsets in enc.batches(pa.array([" " + t for t in texts])):
        for d, t in enumerate(texts[: len(offsets) - 1]):
            assert ids[offsets[d] : offsets[d + 1]].tolist() == enc.model.encode(t), t
        texts = texts[len(offsets) - 1 :]


# -- marks of rows, and ids that repeat (operators 3 and 6)


def test_marks_choose_rows_of_files(spark, tmp_path, monkeypatch):
    """Rows are chosen by place, over many blocks and files, and from a table that is no file."""
    from lectern.llm import common

    monkeypatch.setattr(common, "_INSIDE", 3)
    rows = spark.range(500).selectExpr("id", "id % 7 as n", "'x' as _file", "id as _row")
    rows.repartition(6).write.parquet(f"{tmp_path}/rows")
    F = row_patterns.F
    for df in (spark.read.parquet(f"file://{tmp_path}/rows"), rows, spark.read.parquet(f"file://{tmp_path}/rows").withColumn("_metadata", F.lit(1))):
        own = common.staged(common.located(df, F.col("id").alias("id")), "own")
        assert own.columns == ["id", "place"] and own.select("place").distinct().count() == 500
        folder = common.mark(common.Scratch(spark, "marks"), own.where("id % 5 = 2").select("place"))
        table = own.toPandas()
        assert sorted(table.id[common.marked(folder, table.place.to_numpy())]) == list(range(2, 500, 5))


def test_texts_of_one_id_are_one_node(spark):
    from lectern.llm import jaccard_join

    a, b = ("one two three four five six seven eight", "red green blue white black grey pink brown")
    rows = [(2, a), (3, b), (5, a), (5, b), (7, "so many other words in this text here"), (9, None), (9, b)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x for x in got if x[0] != 9] == [(2, 2), (3, 2), (5, 2), (5, 2), (7, 7)] and (9, 2) in got


# -- 12: row patterns


def plain_zigzags(rows):
    """By the letters each row fits, tried as a regular expression over rows with backtracking."""
    by = collections.defaultdict(set)
    for r in rows:
        if r[1] is not None and r[2] is not None:
            by[r[1]].add(r)
    out = []
    for client, own in by.items():
        own = sorted(own, key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[4] is not None, r[4] or 0, r[3] or ""))
        cents = [None if r[4] is None or not np.isfinite(r[4]) else int(np.floor(100 * r[4] + 0.5)) for r in own]
        near = [i > 0 and own[i][2] - own[i - 1][2] <= datetime.timedelta(minutes=30) for i in range(len(own))]

        def fits(letter, i, start):
            if i >= len(own) or cents[i] is None or not near[i]:
                return False
            if letter == "P":
                return own[i][3] == "click" and cents[i] >= cents[start]
            if own[i][3] in (None, "error") or cents[i - 1] is None:
                return False
            return cents[i] < cents[i - 1] if letter == "D" else cents[i] > cents[i - 1]

        number = 0
        for start in range(len(own)):
            if cents[start] is None:
                continue
            i, labels, best = start + 1, "A", None
            while True:
                d = i
                while fits("D", d, start):
                    d += 1
                u = d
                while fits("U", u, start):
                    u += 1
                if d == i or u == d:
                    break
                labels += "D" * (d - i) + "U" * (u - d)
                i = best = u
            if best is None:
                continue
            if fits("P", i, start):
                labels, i = labels + "P", i + 1
            number += 1
            out.append((client, number, own[start][0], own[i - 1][0], i - start, sum(cents[start:i]), labels))
    return sorted(out)


CLICKS = "click_id long, client_id long, ts timestamp_ntz, kind string, value double, pid long, rows string"


def clicks(seed, n, clients, hot=0.5):
    rng = random.Random(seed)
    at, rows = datetime.datetime(2024, 3, 30, 22), []
    for i in range(n):
        at += datetime.timedelta(seconds=rng.choice([0, 1, 60, 400, 1799, 1800, 1801]) if rng.random() < 0.9 else 4000)
        client = 0 if rng.random() < hot else rng.choice([None, *range(clients)])
        rows.append((rng.choice([i, i, i, 7, None]), client, None if rng.random() < 0.01 else at, rng.choice(["click", "click", "view", "view", "error", None]), rng.choice([None, 1.0, 2.0, 3.005, 4.0, 5.0, 6.0, 7.0, float("nan")] if rng.random() < 0.2 else [rng.random() * 9]), rng.randrange(2), "x"))
    return rows + rng.sample(rows, n // 20)


def found(df):
    return sorted(tuple(r) for r in row_patterns.zigzags(df).select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels").collect())


def without_ties(rows):
    """Of rows that differ only in columns which give no order, the plain version needs one."""
    return list({(r[0], r[1], r[2], r[3], r[4]): r for r in rows}.values())


@pytest.mark.parametrize("seed", range(3))
def test_zigzags_plain(spark, many_ranges, seed):
    rows = without_ties(clicks(seed, 4000, 4))
    df = spark.createDataFrame(rows + rows[:50], CLICKS).repartition(3)
    want = plain_zigzags(rows)
    assert len(want) > 50 and any("P" in r[-1] for r in want)
    assert sorted(found(df), key=repr) == sorted(want, key=repr)


def test_zigzags_over_many_ranges(spark, many_ranges, monkeypatch):
    """One chain without end goes over every range, and its starts are dealt to several rows of work."""
    monkeypatch.setattr(row_patterns, "STARTS", 16)
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, 5, at + datetime.timedelta(minutes=i), "click" if i % 7 else "view", float(100 + i % 2 + (i % 5) / 10), 0, "") for i in range(300)]
    assert found(spark.createDataFrame(rows, CLICKS)) == plain_zigzags(rows)
    # Then rows that are only P, at every place: the end of a range, too.
    rows = [(i, 5, at + datetime.timedelta(minutes=i), "click", (3.0, 1.0, 4.0, 4.0)[i % 4], 0, "") for i in range(300)]
    want = plain_zigzags(rows)
    assert all(r[-1].endswith("P") for r in want[:-2]) and found(spark.createDataFrame(rows, CLICKS)) == want


def test_zigzags_odd(spark):
    at = datetime.datetime(2024, 1, 1)
    minute = datetime.timedelta(minutes=1)
    assert found(spark.createDataFrame([], CLICKS)) == []
    rows = [(1, 1, at, "view", 3.0, 0, ""), (2, 1, at + minute, "view", 1.0, 0, ""), (3, 1, at + 31 * minute, None, 2.0, 0, ""), (4, 2, at, "view", 2.0, 0, "")]
    assert found(spark.createDataFrame(rows, CLICKS)) == []
    rows[2] = (3, 1, at + 31 * minute, "view", 2.0, 0, "")
    assert found(spark.createDataFrame(rows, CLICKS)) == [(1, 1, 1, 3, 3, 600, "ADU")]
    late = [*rows[:2], (3, 1, at + 31 * minute + datetime.timedelta(microseconds=1), "view", 2.0, 0, "")]
    assert found(spark.createDataFrame(late, CLICKS)) == []


def test_long_chain_needs_no_stack(spark):
    text = "du" * 200_000
    row = spark.range(1).select(row_patterns.F.length(row_patterns.F.regexp_extract(row_patterns.F.lit(text + "d"), row_patterns.PATTERN, 1)).alias("n")).first()
    assert row.n == len(text)


# -- 13: suffix dedup


def plain_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    starts = collections.Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for (i, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if starts[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def repeats(df, length):
    rows = suffix_dedup.drop_repeats(df, length=length).collect()
    for r in rows:
        assert len(r.kept) == r.n_bytes - sum(s.stop - s.start for s in r.spans) and all(x.stop < y.start for x, y in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows), key=repr)


def passages(seed, n, length):
    """Texts of random words with passages about as long as ``length``, shifted, cut, next to each other, and copies."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(length // 3) for _ in range(8)] + ["ab" * length, "x" * (2 * length)]
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a : a + rng.randrange(length // 2, len(p))], text(rng.randrange(0, 12))]
        rows.append((i, rng.choice([" ", ""]).join(parts)))
    return rows + [(n + i, rows[i][1]) for i in range(0, n, 7)] + [(0, rows[0][1]), (None, rows[3][1]), (n + 99, None)]


@pytest.mark.parametrize("length", [40, 64])
def test_repeats_plain(spark, many_ranges, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "SMALL", 8)
    rows = passages(length, 60, length)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_repeats(rows, length)
    assert sum(r[2] for r in want) and any(r[3] > 1 for r in want)
    assert repeats(df, length) == want


def test_repeats_of_a_hot_passage(spark, many_ranges):
    """One passage between different words in every row: its suffixes fill several buckets and meet across their edges."""
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(i, f"{rng.random()}" * 3 + passage + f"{rng.random()}" * 3) for i in range(400)]
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100)
    assert got == plain_repeats(rows, 100) and all(r[2] >= 150 for r in got)


def test_repeats_odd(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert repeats(odd, 400) == plain_repeats(rows, 400)
    assert suffix_dedup.drop_repeats(empty).count() == 0
    one = spark.createDataFrame([(1, "q" * 399), (2, "q" * 400), (3, "z" * 401)], "doc_id long, text string")
    assert {r[0]: r[2] for r in repeats(one, 400)} == {1: 0, 2: 0, 3: 401}


def test_long_text_in_parts(monkeypatch):
    """A long text, looked at in parts, has strings under the anchors it has in one, if not the same runs."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    doc, s, n, *_ = suffix_dedup.anchors(data, np.array([0, 5000]), 60, 40)
    assert n.sum() == 5000 - 60 + 1 and (s[1:] == (s + n)[:-1]).all() and len(s) < 5000 / 8


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SMALL", 4)
    rng = np.random.default_rng(3)
    columns = [rng.integers(-3, 3, 5000), rng.integers(-40, 40, 5000), rng.integers(0, 9, 5000)]
    order = suffix_dedup.multikey_quicksort(columns)
    got = list(zip(*(c[order].tolist() for c in columns)))
    assert got == sorted(zip(*(c.tolist() for c in columns))) and sorted(order.tolist()) == list(range(5000))


@needs_tables
def test_repeats_query(spark, many_ranges):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_suffix_array_dedup(spark, SF).collect()), key=repr)
    assert got == plain_repeats(rows, 400) and re.fullmatch("[0-9a-f]{64}", got[0][-1])
