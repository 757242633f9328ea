"""The operators against brute force, round trips and held-out labels, and on odd rows."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, decision_list, flac, html_text, importance, jaccard_join, kernels, language, mixing, packing, pii, queries, token_cache, tokens, trees

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- 6: n-gram Jaccard join


def brute_components(rows, k, num, den):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i].append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(ids, 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: sorted(len(s) for s in sets[i]) for i in ids}


def near_copies(seed, groups=12, per=9, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        if rng.random() < 0.5:
            base[5:5] = passage
        for _ in range(per):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("region", [2, 32])
def test_jaccard_components(spark, region):
    rows = near_copies(region)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), region=region).collect()
    want, sizes = brute_components(rows, 4, 85, 100)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: [r.n_shingles] for r in got} == sizes


def test_jaccard_blocks_recurse(spark, monkeypatch):
    """Many members, few of which are near the pivot: shells and blocks must still find every link."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    rows = near_copies(5, groups=2, per=60, words=50)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), region=4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows, 4, 85, 100)[0]


def test_jaccard_odd(spark, odd, empty):
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(odd).collect()}
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {i: r.component_id for i, r in got.items()} == brute_components(rows, 4, 85, 100)[0]
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[7].component_id == 6
    assert jaccard_join.jaccard_components(empty).collect() == []
    kept = jaccard_join.drop_near_copies(odd.unionByName(odd))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]


# -- 2: FLAC


def test_flac_round_trip():
    rng = np.random.default_rng(0)
    raw = [b"", b"a" * 64, b"text " * 700, bytes(range(256)) * 9, rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), "ñandú 日本".encode() * 300]
    payloads = [flac.padded(np.frombuffer(x, np.uint8)) for x in raw]
    media = flac.encode_all(payloads)
    for x, p, m, (samples, offsets, good, md5) in zip(raw, payloads, media, flac.decode_all(media)):
        assert ((samples[:, 0] + 128).astype(np.uint8) == p).all() and good.all() and md5
        assert p.tobytes()[: len(x)] == x and len(p) % 64 == 0 and offsets[-1] == len(p) and (np.diff(offsets)[:-1] == flac.BLOCK).all()
    assert len(media[2]) < len(payloads[2])


class BitWriter:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, value, k):
        u = value * 2 if value >= 0 else -value * 2 - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        return int((self.bits + "0" * (-len(self.bits) % 8)).ljust(8, "0"), 2).to_bytes((len(self.bits) + 7) // 8, "big")


def plain_crc16(data):
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005) & 0xFFFF if c & 0x8000 else (c << 1) & 0xFFFF
    return c


def hand_made_stream():
    """16 bits, mid/side stereo, no seek table: a fixed subframe with two partitions, one escaped, and a linear one with wasted bits."""
    left = [100, 120, 90, 60, 10, -50, -90, -130, -100, -70, -20, 30, 60, 90, 120, 150]
    right = [96, 110, 92, 64, 18, -42, -94, -126, -104, -62, -24, 38, 56, 98, 112, 158]
    mid, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]
    w = BitWriter()
    w.put(0, 1), w.put(8 + 1, 6), w.put(0, 1)
    w.put(mid[0], 16)
    residual = [b - a for a, b in zip(mid, mid[1:])]
    w.put(0, 2), w.put(1, 4)
    w.put(3, 4)
    for r in residual[:7]:
        w.rice(r, 3)
    w.put(15, 4), w.put(9, 5)
    for r in residual[7:]:
        w.put(r, 9)
    assert all(s % 2 == 0 for s in side)
    half = [s // 2 for s in side]
    w.put(0, 1), w.put(32 + 1, 6), w.put(1, 1), w.put(1, 1)  # one wasted bit
    w.put(half[0], 16), w.put(half[1], 16)
    w.put(5 - 1, 4), w.put(2, 5), w.put(3, 5), w.put(-2, 5)
    w.put(1, 2), w.put(0, 4), w.put(2, 5)
    for i in range(2, 16):
        w.rice(half[i] - ((3 * half[i - 1] - 2 * half[i - 2]) >> 2), 2)
    head = b"\xff\xf8" + bytes([6 << 4, 10 << 4 | 4 << 1]) + b"\x00" + bytes([15])
    frame = head + bytes([flac.crc8(head)]) + w.bytes()
    frame += plain_crc16(frame).to_bytes(2, "big")
    pcm = np.array([left, right], "<i2").T
    packed = (44100 << 44) | (1 << 41) | (15 << 36) | 16
    info = b"\x00\x10\x00\x10" + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(pcm.tobytes()).digest()
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + frame, pcm


def test_flac_decodes_what_the_encoder_never_writes():
    stream, pcm = hand_made_stream()
    ((samples, _, good, md5),) = flac.decode_all([stream])
    assert (samples == pcm).all() and good.all() and md5


def test_flac_damage(spark):
    good = flac.encode_all([flac.padded(np.frombuffer(b"some text " * 300, np.uint8))])[0]
    bad = bytearray(good)
    bad[-40] ^= 1
    df = spark.createDataFrame([(1, bytearray(good)), (2, bad), (3, bytearray(b"nothing")), (4, None)], "doc_id long, media binary")
    rows = flac.pcm_blocks(df).orderBy("doc_id", "block").collect()
    assert all(r.crc_ok and r.md5_ok for r in rows if r.doc_id == 1) and [r.sample_offset for r in rows if r.doc_id == 1] == [0, 1024, 2048]
    two = [r for r in rows if r.doc_id == 2]
    assert not all(r.crc_ok for r in two) or two[0].error
    assert all(r.error for r in rows if r.doc_id > 2)


def test_media_digest(odd, empty):
    for r in flac.media_digest(odd).collect():
        text = next(x.text for x in odd.where(F.col("doc_id") == r.doc_id).collect()) or ""
        raw = text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert flac.media_digest(empty).collect() == []


# -- 3, 4: tokens

HARD = ["don't we'll they've 'Tis I'd'nt 're'", "  two  spaces \n\n x\t\ty ", "<|endoftext|>a b", "", "日本語 テキスト 123 ½ ² ١٢", "'s", "x' s 'll'll", "\x1c\x1da \x85b", "!!!???" * 50, "a" * 3000, "end  ", " "]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_equals_library():
    rng = random.Random(4)
    texts = HARD + ["".join(rng.choice("ab'stdmrevl 1\n.é日 ") for _ in range(rng.randrange(60))) for _ in range(400)]
    got = []
    for ids, offsets in tokens.Encoder(tokens.tokenizer_path()).batches(pa.array([*texts, None])):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == library([*texts, None])


def test_other_tokenizers():
    got = []
    for ids, offsets in tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json")).batches(pa.array(["Hello there", ""])):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got[0] and got[1] == []


def test_token_cache(spark, odd, empty, tmp_path):
    cache = f"file://{tmp_path}/cache"
    path = tokens.tokenizer_path()
    want = {r.doc_id: len(library([r.text])[0]) for r in odd.collect()}
    for _ in range(2):
        got = token_cache.count_tokens(odd.unionByName(odd), path, cache, limit=5).collect()
        assert len(got) == 2 * len(want) and {r.doc_id: r.n_tokens for r in got} == want
        assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    stored = token_cache.read_cache(spark, cache)
    assert stored.count() == stored.select("text_digest").distinct().count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_cache.count_tokens(empty, path, cache).collect() == []
    # Stored counts are used: a false one shows.
    spark.createDataFrame([(bytearray(hashlib.sha256(b"planted").digest()), token_cache.tokenizer_digest(path), 999)], token_cache.SCHEMA).write.mode("append").parquet(cache)
    assert token_cache.count_tokens(spark.createDataFrame([(1, "planted")], "doc_id long, text string"), path, cache).first().n_tokens == 999


def test_best_fit():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 500)
    bins, offsets, fills = packing.best_fit(sizes, 100)
    for b in range(len(fills)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert (np.cumsum(sizes[own]) - sizes[own] == offsets[own]).all() and sizes[own].sum() == fills[b] <= 100
    assert len(fills) <= 1.03 * np.ceil(sizes.sum() / 100) + 1


def check_packing(rows, texts, capacity=2048):
    by = collections.defaultdict(list)
    docs = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    for i, t in texts.items():
        ids = np.array([*library([t])[0], 0], "<u4")
        own = sorted(docs[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        assert all(r.length == capacity for r in own[1:])
    return len(by)


def test_packing(spark, odd, empty):
    rng = random.Random(1)
    texts = {100 + i: " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(1, 900))) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9)
    rows = packing.pack(df, tokens.tokenizer_path()).collect()
    n = check_packing(rows, texts)
    assert n <= np.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1
    check_packing(packing.pack(odd, tokens.tokenizer_path()).collect(), {r.doc_id: r.text for r in odd.collect()})
    assert packing.pack(empty, tokens.tokenizer_path()).collect() == []


# -- 5: HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy &amp; save now</div>
%s<aside>Side words here</aside><form><label>Mail</label><input></form><div id="comments"><p>First! A reader's long comment about nothing at all, as they are.</p></div>
<footer>&copy; 2020 someone</footer></body></html>"""


def test_html_article():
    body = "<article><h1>Head &eacute;</h1><p><b>One   two<br>three<p>Four &lt;five&gt;</p><!-- no --><ul><li>six<li>seven</ul></article>"
    assert html_text.main_text(PAGE % body) == "Head é\nOne two three\nFour <five>\nsix\nseven"


def test_html_without_article():
    words = "Some words of a paragraph that is long enough to be dense. " * 4
    body = f"<div id='x'><h1>Head</h1><div class='body'><p>{words}</p><p>{words}</p></div></div><div><a href='/1'>x</a> <a href='/2'>y</a></div>"
    text = html_text.main_text(PAGE % body)
    assert text.split("\n") == ["Head", words.strip(), words.strip()]


def test_html_names_are_overruled():
    words = "Some words of a paragraph that is long enough to be dense. " * 4
    article = f"<article><h1>Head</h1><p>{words}</p></article>"
    want = ["Head", words.strip()]
    bar = "<div class='sidebar'><p>Short notes at the side</p></div>"
    for name in ("layout with-sidebar", "no-sidebar", "has-nav", "post share"):
        for inner in (article, f"<h1>Head</h1><p>{words}</p>", f"<div class='has-nav'>{article}</div>"):
            assert html_text.main_text(PAGE % f"<div class='{name}'>{inner}{bar}</div>").split("\n") == want, (name, inner)
    comments = "<div class='comments'>" + f"<div class='comment'><p>{words}</p></div>" * 3 + "</div>"
    assert html_text.main_text(PAGE % (article + comments)).split("\n") == want
    assert html_text.main_text(PAGE % f"{article}<div class='related'><article><p>Another one</p></article></div>").split("\n") == want


def test_html_bare_text():
    words = "Some words of a paragraph that is long enough to be dense. " * 4
    body = f"<div>First bare <b>bold</b> text.<div><p>{words}</p><p>{words}</p></div>Last bare text.</div>"
    assert html_text.main_text(f"<html><body>{body}</body></html>").split("\n") == ["First bare bold text.", words.strip(), words.strip(), "Last bare text."]


def test_density_decides():
    """No names at all: divisions without classes, links as menus. The article is the subtree of the greatest sum."""
    words = [f"Sentence number {i} of a paragraph says a few things about its subject, and goes on for a while." * (1 + i % 3) for i in range(8)]
    menu = "<div>" + "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(12)) + "</div>"
    article = "<div><div>Title of it all</div>" + "".join(f"<div>{w}</div>" for w in words) + "</div>"
    for page in (menu + "<div>Buy this now</div>" + article + "<div>© nobody</div>" + menu, f"<div>{menu}<div>{article}</div></div>{menu}", f"<div><div>{menu}</div><div><div>{article}</div></div></div>"):
        assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == ["Title of it all", *words]


def brute_density(page):
    """The densities by walking the subtree of each node."""
    n = len(page.tag)
    below = lambda i: [i, *(j for x in page.items[i] if isinstance(x, int) and not page.off[x] for j in below(x))]
    inside = lambda i: i >= 0 and (page.tag[i] == "a" or inside(page.parent[i]))
    text = lambda nodes: sum(len(x.strip()) for i in nodes for x in page.items[i] if isinstance(x, str))
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    linked = lambda nodes: text([j for j in nodes if inside(j)])
    share = linked(below(body)) / max(text(below(body)), 1)
    out = []
    for i in range(n):
        nodes = below(i)
        c, lc = text(nodes), linked([j for j in nodes])
        t, lt = max(len(nodes) - 1, 1), max(sum(page.tag[j] == "a" for j in nodes if j != i), 1)
        if not c or page.off[i]:
            out.append(0.0)
            continue
        base = np.log(np.log(c / max(c - lc, 1) * lc + share * c + np.e))
        out.append(c / t * np.log(max(c / max(lc, 1) * t / lt, 1.0000001)) / base if base > 0 else None)
    return out


def test_density_equals_brute_force():
    words = "Words of a paragraph. "
    source = f"<html><body><div><a href='/'>Home</a> <a href='/x'>Next page</a></div><div><h1>Head</h1><p>{words * 5}<a href='/y'>a link</a> {words}</p><p>{words * 3}</p></div><div>{words}</div></body></html>"
    page = html_text.Page(source)
    density, sums, _ = page.densities()
    want = brute_density(page)
    assert density == pytest.approx(want) and sum(want) > 0
    for i in range(len(want)):
        assert sums[i] == pytest.approx(sum(want[x] for x in page.items[i] if isinstance(x, int)))


@needs_tables
def test_names_are_not_needed(spark):
    """Elements renamed to divisions, classes gone: density finds nearly all of the same texts."""
    pages = [r.html for r in common.table(spark, SF, "pages").collect()]
    bare = [re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(nav|article|h1|footer)\b", r"<\1div", h)) for h in pages]
    assert np.mean([html_text.main_text(a) == html_text.main_text(b) for a, b in zip(pages, bare)]) > 0.85


def test_html_keeps_what_is_text():
    page = '<article><p>The formula <math>a+b</math> holds and <button>inline</button> <label>text</label>.</p><div class="share-price"><p>Share price fell.</p></div><form><label>Mail</label></form></article>'
    assert html_text.main_text(page) == "The formula a+b holds and inline text.\nShare price fell."


@pytest.mark.parametrize("part", ["<a '", '<a x="', "<!", "<b><h1>", "</x>", "<div class=nav>", "<li><b>", "<p><i>"])
def test_hostile_pages_are_read_once(part):
    import time

    took = []
    for n in (4000, 32_000):
        began = time.perf_counter()
        html_text.main_text(part * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.5


def test_html_odd(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain words"), (4, "u", "<p>open <b>never closed"), (5, "u", "<" * 1000), (6, "u", "<div>" * 20_000 + "deep"), (7, "u", "<!-- never closed"), (8, None, "<form><p>Only a form holds the text of this page</p></form>")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == got[2].text == got[7].text == "" and got[3].text == "plain words" and got[4].text == "open never closed" and got[6].text == "deep"
    assert got[8].text and all(r.n_chars == len(r.text) for r in got.values())


# -- 7: decision lists


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd, empty):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "#d", "é"]) + rng.choice(["", "", "\n"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    keep = decision_list.DecisionList([])
    source = {r.doc_id: r.text for r in df.collect()}
    for r in decision_list.judge(df, keep).collect():
        s = brute_statistics(source[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and r.kept == (not r.base_failed)
    assert decision_list.judge(empty, keep).collect() == []


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a hash of few bits many windows collide; equal words decide."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(200)) for _ in range(20)] + [" ".join(f"w{i}" for i in range(3000))]
    monkeypatch.setattr(decision_list, "EXTRA_BITS", 48)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in decision_list.judge(df, decision_list.DecisionList([])).collect():
        assert r.n_repeat_words == brute_statistics(texts[r.doc_id])[4]


def test_rules_as_expression(spark):
    """The emitted CASE says what the list says, in its order."""
    rng = np.random.default_rng(4)
    x = rng.random((500, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)
    rules = decision_list.learn(x, bad, ("a", "b", "c"))
    assert rules.rules
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r.kept for r in df.select(rules.verdict(F.col).alias("kept")).collect()]
    holds = lambda row, t: row["abc".index(t.statistic)] > t.cut if t.above else row["abc".index(t.statistic)] <= t.cut
    assert got == [not any(all(holds(row, t) for t in rule) for rule in rules.rules) for row in x]


def test_rules_of_repeated_ids(spark):
    rows = [(i % 40, f"word{i % 40} " * (60 if i % 2 else 10), "x") for i in range(4000)] + [(None, "text", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (None, 0)], "doc_id long, quality int")
    rules = decision_list.fit(df, labels)
    assert decision_list.judge(df, rules).count() == 4001 and "stats" in decision_list.statistics(df).columns


def test_decision_list_learns():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)
    rules = decision_list.learn(x, bad, ("a", "b", "c"))
    said = np.zeros(3000, bool)
    for rule in rules.rules:
        hit = np.ones(3000, bool)
        for t in rule:
            v = x[:, "abc".index(t.statistic)]
            hit &= v > t.cut if t.above else v <= t.cut
        said |= hit
    assert (said == bad).mean() > 0.97
    assert decision_list.learn(x, np.zeros(3000, bool), ("a", "b", "c")).rules == []


# -- 8: personal data


def brute_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
        if 12 <= len(d) <= 19 and sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark):
    rng = random.Random(8)
    texts = ["a@b.c..d@e.f 4111 1111 1111 1111- 4111-1111-1111-1111 1.2.3.4.5.6.7.8 999.1.1.1 +1 (222) 333-4444", "", "1 " * 9000, "a" * 60_000 + "@b.c", "a@" + "b." * 9000 + "c", "9" * 60_000, "1.2." * 1500]
    texts += ["".join(rng.choice("ab@..--  +()0123456789é") for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "doc_id long, text string").repartition(8)
    none = pii.PiiModel(trees.BoostedTrees(-9.0, []), 0.0)
    for r in pii.pii_report(df, none).collect():
        spans = brute_spans(texts[r.doc_id] if r.doc_id < 9999 else "")
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest() and r.spans == joined(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]


@pytest.fixture(scope="module")
def prose(spark):
    """Texts without anything personal, into which plants can go."""
    rng = random.Random(50)
    words = "the of and a to in is it that was for on are as with his they at be this have from or one had by word but not what all were we when".split()
    return spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(120)) + f" in 19{i % 90 + 10} or {i} of them.") for i in range(400)], "doc_id long, text string")


@pytest.fixture(scope="module")
def pii_model(prose):
    return pii.fit(prose)


def other_plants(rng):
    """(text, value or None): personal values and look-alikes that this test makes by itself, in sentences of its own."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))

    def iban():
        body = digits(18)
        flat = f"DE{98 - int(body + '131400') % 97:02d}" + body
        return " ".join(flat[i : i + 4] for i in range(0, 22, 4)) if rng.random() < 0.5 else flat

    good = [
        lambda: ("My SSN: {}, please keep it.", f"{rng.randrange(100, 900)}-{digits(2)}-{digits(4)}"), lambda: ("Send the money to {} today", iban()),
        lambda: ("You can call ({}) any time", f"{rng.randrange(200, 990)}) {rng.randrange(200, 990)}-{digits(4)}"), lambda: ("phone: {} or later", f"{rng.randrange(200, 990)}-{rng.randrange(200, 990)}-{digits(4)}"),
        lambda: ("login with password: {} and go on", rng.choice(["correct-horse-battery", "hunter" + digits(2), "Tr0ub4dor&" + digits(1), "sunflower"])), lambda: ("aws_secret_access_key = {} is in the file", mixed(40)),
        lambda: ("header Authorization: Bearer {} was sent", f"eyJ{mixed(18)}.eyJ{mixed(40)}.{mixed(43)}"), lambda: ("export API_KEY={} first", hexes(32)), lambda: ("write to {} for more", f"jane.doe{digits(1)} at example dot org"),
        lambda: ("the key {} leaked", "AKIA" + mixed(16).upper()), lambda: ("acct no. {} was charged", digits(10)),
    ]
    bad = [
        lambda: "fixed in commit " + hexes(40) + " last week", lambda: "see commit " + hexes(8) + " for that", lambda: f"upgrade to version {digits(1)}.{digits(2)}.{digits(1)} now", lambda: f"on 20{digits(2)}-0{rng.randrange(1, 10)}-1{digits(1)} they met",
        lambda: f"checksum {hexes(32)} is right", lambda: f"ISBN 978-0-{digits(2)}-{digits(6)}-{digits(1)} is a book", lambda: f"about {digits(2)},{digits(3)},{digits(3)} people", lambda: f"order ORD-{digits(5)} was sent", lambda: "the secret is out now", lambda: f"max_tokens = {digits(4)} is set",
    ]
    for i in range(44):
        for f in good:
            frame, value = f()
            yield frame.format(value), value
        for f in bad:
            yield f(), None


def test_planted_personal_data(spark, prose, pii_model):
    rng = random.Random(77)
    rows = list(other_plants(rng))
    words = [r.text.split(" ") for r in prose.limit(60).collect()]
    texts = []
    for t, _ in rows:
        w = rng.choice(words)
        texts.append(" ".join(w[:20]) + " " + t + " " + " ".join(w[20:40]))
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pii_model).collect()}
    caught = collections.Counter()
    for i, (_, value) in enumerate(rows):
        spans = [x.split(":") for x in got[i].spans.split(",") if x]
        assert got[i].n_spans == len(spans)
        if value is None:
            caught["clean"] += not spans
        else:
            at = texts[i].index(value)
            covered = {p for _, a, b in spans for p in range(int(a), int(b))}
            caught["personal"] += sum(p in covered for p in range(at, at + len(value))) >= 0.8 * len(value)
    n = sum(v is not None for _, v in rows)
    assert caught["personal"] >= 0.9 * n and caught["clean"] >= 0.95 * (len(rows) - n), (caught, n)


def test_redact(spark, empty, odd, pii_model):
    text = "first 555-00-1234 then IBAN DE89 3704 0044 0532 0130 00, mail a@b.example and password: correcthorse end"
    long = "word " * 4090 + text + " more" * 3000 + " x@y.example 1.2.3.4"
    rows = [(1, text, "mine", "too"), (2, long, None, None), (3, None, "x", "y"), (4, "nothing here", "x", "y"), (5, "a@b.example" * 900, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string, pii_base string")
    out = {r.doc_id: r for r in pii.redact(df, pii_model).collect()}
    assert out[1].text == "first [SSN] then IBAN [IBAN], mail [EMAIL] and password: [SECRET] end" and (out[1].pii_spans, out[1].pii_base) == ("mine", "too")
    assert out[2].text == "word " * 4090 + out[1].text + " more" * 3000 + " [EMAIL] [IP]" and out[3].text is None and out[4].text == "nothing here"
    spans = brute_spans(rows[4][1])
    assert out[5].text.count("[EMAIL]") == len(spans)
    with pytest.raises(ValueError):
        pii.find_pii(df, pii_model)
    assert pii.fit(empty).trees.trees == [] and pii.pii_report(empty, pii_model).collect() == [] and pii.redact(empty, pii_model).collect() == []
    none = pii.fit(empty)
    assert [r.text for r in pii.redact(odd, none).orderBy("doc_id").collect()] == [r.text for r in odd.orderBy("doc_id").collect()]


def plain_choice(items):
    """Of (start, end, loss, ...) the best that overlap none kept before."""
    kept = []
    for c in sorted(items, key=lambda c: (c[2], c[0] - c[1], c[0])):
        if all(c[1] <= k[0] or k[1] <= c[0] for k in kept):
            kept.append(c)
    return sorted(c[:2] for c in kept)


def test_choice_of_spans(spark):
    rng = random.Random(9)
    sets = [[], [(3, 5, 1.0)], [(2 * i, 2 * i + 3, -float(i)) for i in range(300)], [(2 * i, 2 * i + 3, float(i)) for i in range(300)], [(0, 10_000, -1.0)] + [(i, i + 2, 0.5) for i in range(0, 9000, 3)], [(0, 10_000, 1.0)] + [(i, i + 2, 0.5) for i in range(0, 9000, 3)]]
    for n in (2, 5, 63, 64, 65, 300, 4095, 4097):
        wide = rng.choice((20, 400, 4 * n))
        starts = [rng.randrange(wide) for _ in range(n)]
        sets.append([(a, a + rng.randrange(1, 12), float(rng.randrange(8))) for a in starts])
    for _ in range(60):
        sets.append([(a, a + rng.randrange(1, 9), float(rng.randrange(5))) for a in (rng.randrange(40) for _ in range(rng.randrange(30)))])
    rows = [(i, [(a, b, (loss, a - b, a), 9) for a, b, loss in s]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, f"i int, p {pii._PICKED}")
    for r in df.select("i", pii._chosen(F.col("p")).alias("p")).collect():
        assert sorted((c.start, c.end) for c in r.p) == plain_choice(sets[r.i]), sets[r.i][:20]


def plain_candidates(x):
    """(start, end, value, before) of every generator, by Python's patterns."""
    leads = {pii.TOKEN: (r"^(?:[^=:]*+[=:])?[\"'(\[{<]*", 6, pii._ENDING), pii.ASSIGNED: (None, 1, pii._ENDING), pii.SPELLED: ("", 6, None), pii.GROUPS: ("", 6, None), pii.IBAN: ("", 6, None), pii.NUMBER: (None, 6, None)}
    own = {pii.ASSIGNED: pii._CREDENTIAL + pii._ASSIGNS, pii.NUMBER: pii._NUMBER_OF}
    out = set()
    for pattern, (lead, least, ending) in leads.items():
        last = 0
        for m in re.finditer(pattern, x, re.A):
            head = re.match(own.get(pattern, lead), m[0], re.A)[0]
            value = m[0][len(head) :]
            value = re.sub(ending, "", value, flags=re.A) if ending else value
            if len(value) >= least:
                out.add((m.start() + len(head), m.start() + len(head) + len(value), value, x[last : m.start()][-48:] + head))
            last = m.end()
    return out


def test_added_spans_against_plain(spark, pii_model):
    rng = random.Random(78)
    made = [t for t, _ in other_plants(rng)]
    pieces = [*made, "a.b@c.example", "(743) 555-3824", "555 12 34 56 78 90 12-34-56-78", "call 212-555-0147", "10.0.0.1", "+1 415 555 2671", "token=12-34-56-78-90", "4111 1111 1111 1111", "ssn 078-05-1120", "no data", "é日本"]
    texts = [rng.choice((" ", ", ", "\n")).join(rng.choice(pieces) for _ in range(n)) for n in (1, 2, 3, 8, 40, 700) for _ in range(8 if n < 100 else 2)]
    texts.append("12-34-56." * 3000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    proposed = collections.defaultdict(list)
    for r in df.select("doc_id", F.explode(pii.candidates(F.col("text"))).alias("c")).collect():
        proposed[r.doc_id].append(tuple(r.c))
    rows = sorted({c[2:] for own in proposed.values() for c in own})
    described = spark.createDataFrame(rows, "value string, before string").select("value", "before", F.array(*pii.features(F.col("value"), F.col("before"))).alias("x"), pii._kind(F.col("value")).alias("kind")).collect()
    score = dict(zip([(r.value, r.before) for r in described], pii_model.trees.score(np.array([r.x for r in described]))))
    kind = {r.value: r.kind for r in described}
    for r in pii.pii_report(df, pii_model).collect():
        x = texts[r.doc_id]
        own = plain_candidates(x)
        assert len(proposed[r.doc_id]) == len(own) and set(proposed[r.doc_id]) == own
        base = brute_spans(x)
        free = [c for c in own if all(c[1] <= a or b <= c[0] for a, _, b in base)]
        some = [(a, b, -score[v, w]) for a, b, v, w in free if score[v, w] >= pii_model.threshold]
        spans = sorted(base + [(a, kind[x[a:b]], b) for a, b in plain_choice(some)])
        assert r.spans == joined(spans) and r.n_added == len(spans) - len(base)


def test_dense_long_text(spark, pii_model):
    """A list of contacts: every span is named once, and nothing else of the text changes."""
    x = "".join(f"p{i}@m{i % 9}.example ({i % 700 + 200}) 555-{i % 10_000:04d}\n" for i in range(12_000))
    df = spark.createDataFrame([(1, x)], "doc_id long, text string")
    spans = [s.split(":") for s in pii.pii_report(df, pii_model).collect()[0].spans.split(",")]
    assert sum(k == "email" for k, _, _ in spans) == 12_000 and len(spans) > 20_000
    out, at = [], 0
    for k, a, b in spans:
        if int(a) >= at:
            out += [x[at : int(a)], f"[{k.upper()}]"]
        at = max(at, int(b))
    assert pii.redact(df, pii_model).collect()[0].text == "".join(out) + x[at:]


def test_candidates_overlap(spark):
    rows = [(1, 'the "password": "correcthorse" of one'), (2, "call (743) 555-3824 or write to me at host dot example"), (3, "DE89 3704 0044 0532 0130 00")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    proposed = {(r.doc_id, r.c.value) for r in df.select("doc_id", F.explode(pii.candidates(F.col("text"))).alias("c")).collect()}
    assert {(1, "correcthorse"), (2, "(743) 555-3824"), (2, "me at host dot example"), (3, "DE89 3704 0044 0532 0130 00"), (3, "3704 0044 0532 0130 00")} <= proposed


def test_trees_as_expression(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = trees.boost(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r.s for r in df.select(model.expression([F.col(c) for c in "abc"]).alias("s")).collect()]
    assert np.allclose(got, model.score(x)) and ((model.score(x) > 0) == (y > 0)).mean() > 0.9


# -- 9: languages


@needs_tables
def test_language_held_out(spark):
    got = queries.op9_string_kernels(spark, SF).join(common.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang is not None]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_learns_every_label(spark):
    rng = random.Random(9)
    word = lambda k: "".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(4))
    rows = [(100 * k + i, " ".join(word(k) for _ in range(60)), f"l{k:02d}") for k in range(80) for i in range(8 if k < 70 else 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.labels == [f"l{k:02d}" for k in range(80)]
    new = [(k, " ".join(word(k) for _ in range(60))) for k in range(80)]
    got = language.identify(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id:02d}" for r in got) and len(got) == 80


def brute_scores(train, texts, model_vocabulary, landmarks):
    """Kernel ridge regression by sets of n-grams, without presence rows."""
    def grams(t):
        raw = re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode()).translate(bytes(language._LOWER))
        return {(n << 32) | int.from_bytes(raw[i : i + n], "big") for n in range(1, 5) for i in range(len(raw) - n + 1)}

    vocabulary = set(model_vocabulary.tolist())
    inside = {i: grams(t) & vocabulary for i, t, _ in train}
    marks = [i for i in landmarks]
    k = lambda a, b: len(a & b) / max(1, len(a)) ** 0.5 / max(1, len(b)) ** 0.5
    values, vectors = np.linalg.eigh(np.array([[k(inside[a], inside[b]) for b in marks] for a in marks]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[k(inside[i], inside[b]) for b in marks] for i, _, _ in train]) @ root
    labels = sorted({lang for _, _, lang in train})
    y = np.array([[1.0 if lang == label else -1.0 for label in labels] for _, _, lang in train])
    mean, shift = phi.mean(0), y.mean(0)
    alpha = np.linalg.solve((phi - mean).T @ (phi - mean) + language.RIDGE * len(phi) * np.eye(phi.shape[1]), (phi - mean).T @ (y - shift))
    test = np.array([[k(grams(t) & vocabulary, inside[b]) for b in marks] for t in texts]) @ root
    return labels, (test - mean) @ alpha + shift


def test_language_equals_plain_kernel_ridge(spark):
    rng = random.Random(12)
    sounds = {"en": "the and ing tion er on at".split(), "de": "der und ung sch ein ich ver".split(), "fr": "les des eau oui que tion ai".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    train = [(i, make(lang, rng.randrange(5, 40)), lang) for i, lang in enumerate(list(sounds) * 20)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), landmarks=6, training=20)
    order = sorted(train, key=lambda r: (r[2], zlib.crc32(str(r[0]).encode()), str(r[0])))
    landmarks = [r[0] for lang in sounds for r in [x for x in order if x[2] == lang][:6]]
    landmarks.sort(key=lambda i: next(j for j, r in enumerate(order) if r[0] == i))
    texts = [make(lang, 12) for lang in list(sounds) * 10]
    labels, want = brute_scores(order, texts, model.vocabulary, landmarks)
    assert labels == model.labels
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, f in enumerate(want):
        e = np.exp(4 * (f - f.max()))
        assert got[i].lang_pred == labels[int(f.argmax())] and got[i].score == pytest.approx(e.max() / e.sum(), abs=1e-3)


def test_language_odd(spark, odd, empty):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze im haus", "de")] * 6)], "doc_id long, text string, lang string")
    model = language.fit(train)
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert len(got) == 11 and {got[i].lang_pred for i in (1, 2, 3, 11)} == {"und"} and got[6].lang_pred == "en"
    assert language.identify(empty, model).collect() == [] and language.fit(empty).labels == []
    assert {r.lang_pred for r in language.identify(odd, language.fit(empty)).collect()} == {"und"}
    out = language.with_language(odd, model)
    assert out.columns == odd.columns and out.count() == 11


# -- 10: mixing


def test_water_fill():
    assert mixing.water_fill(10, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert mixing.water_fill(10, {"a": 1, "b": 0}, {"a": 4, "b": 100}) == {"a": 4, "b": 6}
    assert mixing.water_fill(10, {"a": 1, "b": 1}, {"a": 1, "b": 2}) == {"a": 1, "b": 2}


def test_shortage_stays_with_siblings():
    leaves = {("d", "en", "x"): 10.0, ("d", "en", "y"): 90.0, ("d", "fr", "z"): 100.0}
    plan = mixing.budget_tree(leaves, {("d", "en"): 0.5, ("d", "fr"): 0.5, ("d", "en", "x"): 0.5, ("d", "en", "y"): 0.5}, 100)
    assert plan == pytest.approx({("d", "en", "x"): 10, ("d", "en", "y"): 40, ("d", "fr", "z"): 50})


def plain_selection(keys, size, plan, leaves, max_epochs, key):
    """What each leaf's prefix has to be, by sorting the leaf: how often each key is taken. keys: (key, leaf) of rows."""
    want = collections.Counter()
    for leaf, b in plan.items():
        own = [k for k, at in keys if at == leaf]
        whole = int((b + 1e-6) // leaves[leaf])
        for k in own:
            want[k] += whole
        before = 0
        for k in sorted(own, key=lambda k: key(k, whole)):
            if before < b - whole * leaves[leaf] - 1e-6 and whole < max_epochs:
                want[k] += 1
            before += size[k]
    return +want


def test_mix_prefix(spark, odd, empty):
    rng = random.Random(2)
    path = tokens.tokenizer_path()
    rows = [(i if i % 7 else None, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(60))) + f" {i % 90}", rng.choice(["en", "fr"]), rng.choice(["a", "a", "a", "b"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = F.lit("d")
    size = {t: max(1, len(x)) for (_, t, _, _), x in zip(rows, library([t for _, t, _, _ in rows]))}
    leaves = collections.Counter()
    for _, t, lang, source in rows:
        leaves["d", lang, source] += size[t]
    weights = {("d", "en"): 0.2, ("d", "fr"): 0.8}
    budget = 0.9 * sum(leaves.values())
    plan = mixing.budget_tree({k: 2.0 * v for k, v in leaves.items()}, weights, budget)
    got = collections.Counter((r.doc_id, r.text) for r in mixing.mix(df, path, weights, budget, domain=one, max_epochs=2).collect())
    order = {}
    keyed = df.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(17)).alias("h"))
    for r in keyed.select("doc_id", "text", *(mixing._order(F.lit(e)).alias(f"o{e}") for e in range(3))).collect():
        order[r.doc_id, r.text] = (r.o0, r.o1, r.o2)
    keys = [((i, t), ("d", lang, s)) for i, t, lang, s in rows]
    sizes = {(i, t): size[t] for i, t, _, _ in rows}
    assert got == plain_selection(keys, sizes, plan, leaves, 2, lambda k, e: order[k][e])
    again = mixing.mix_ids(df.repartition(5), path, weights, budget, domain=one, max_epochs=2).collect()
    assert collections.Counter(i for i, _ in got.elements()) == collections.Counter(r.doc_id for r in again)
    assert sum(r.n_tokens for r in again) == sum(sizes[k] * n for k, n in got.items())
    everything = mixing.mix(odd, path, {}, domain=one)
    assert everything.count() == 11 and set(odd.columns) <= set(everything.columns)
    assert mixing.mix(empty, path, {}, domain=one).collect() == []


def test_mix_cuts_inside_ties(spark):
    path = tokens.tokenizer_path()
    text = "some words " * 20
    n = len(library([text])[0])
    for key in (7, None):
        df = spark.createDataFrame([(key, text, "en", "a")] * 1000, "doc_id long, text string, lang string, source string").repartition(7)
        assert mixing.mix(df, path, {}, 100.5 * n, domain=F.lit("d")).count() == 101
        assert mixing.mix(df, path, {}, 2100 * n, domain=F.lit("d")).count() == 2100
    several = spark.createDataFrame([(None, f"{text}{i % 500}", "en", "a") for i in range(1000)], "doc_id long, text string, lang string, source string")
    got = mixing.mix(several, path, {}, 50 * n, domain=F.lit("d")).count()
    assert 40 <= got <= 51


# -- 1: importance resampling


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0.5, 0.5, rng.random(), 0.5 + 2**-50])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key double")
    for k in (0, 1, 60, 200, 333, 500, 900):
        want = {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}
        assert {r.id for r in importance.top_k(df, "key", k, "id").where("selected").collect()} == want


def test_importance_equals_plain_models(spark, monkeypatch):
    """Cells, ratios, keys and the draw, by dictionaries of n-grams (the cells are many enough to keep these apart)."""
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randrange(30)))) for i in range(200)] + [(None, "one two"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, int(i % 10 == 1)) for i in range(0, 120)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    target = {i for i in range(120) if i % 2 == 1 and i % 10 != 1}
    grams = lambda t: (lambda w: [*((x,) for x in w), *zip(w, w[1:])])(WORD.findall(t or ""))
    raw, good = collections.Counter(), collections.Counter()
    monkeypatch.setattr(importance, "SMOOTHS", (2.0,))
    for i, t in rows:
        raw.update(grams(t))
        if i in target:
            good.update(grams(t))
    share = sum(good.values()) / sum(raw.values())
    ratio = {g: np.log((good[g] + 2.0) / (raw[g] * share + 2.0)) for g in raw}
    got = importance.importance_resample(df, labels).collect()
    noise = {r.doc_id: r.u for r in df.select("doc_id", ((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) + 0.5) / float(1 << 53)).alias("u")).collect()}
    want = {(i, len(grams(t))): sum(ratio[g] for g in grams(t)) if grams(t) else importance.NOTHING for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.log_ratio == pytest.approx(want[r.doc_id, r.n_grams], abs=1e-6) and r.key == pytest.approx(r.log_ratio - np.log(-np.log(noise[r.doc_id])), abs=1e-6)
    k = round(sum(min(1.0, np.exp(r.log_ratio)) for r in got))
    assert sum(r.kept for r in got) == k and min(r.key for r in got if r.kept) >= max(r.key for r in got if not r.kept)


def test_smoothing_is_held_out(spark):
    """Half of the target text, scored by the other half's counts, decides how much a rare n-gram says."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice([f"w{rng.randrange(9000)}", "the", "of"]) for _ in range(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("target", F.when(F.col("doc_id") < 200, 1 + F.col("doc_id") % 2))
    ratio = importance.log_ratios(df, F.col("target"))
    raw, halves = collections.Counter(), (collections.Counter(), collections.Counter())
    grams = lambda t: (lambda w: [*((x,) for x in w), *zip(w, w[1:])])(t.split())
    for i, t in rows:
        raw.update(grams(t))
        if i < 200:
            halves[i % 2].update(grams(t))
    total = sum(raw.values())
    drawn = []
    for s in importance.SMOOTHS:
        scores = [sum(np.log((halves[1 - i % 2][g] + s) / (raw[g] * sum(halves[1 - i % 2].values()) / total + s)) for g in grams(t)) for i, t in rows[:200]]
        drawn.append(np.mean(np.exp(np.minimum(scores, 0))))
    best = next((s for s, d in zip(importance.SMOOTHS, drawn) if d >= importance.HELD_OUT), importance.SMOOTHS[int(np.argmax(drawn))])
    word = next(g for g in raw if raw[g] == 2 and halves[0][g] + halves[1][g] == 0)
    share = sum(sum(h.values()) for h in halves) / total
    assert round(float(ratio.min()), 6) == round(float(min(np.log((halves[0][g] + halves[1][g] + best) / (raw[g] * share + best)) for g in raw)), 6) and word


def test_importance(spark, odd, empty):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice"] if i % 3 else ["bad", "junk", "spam"]) for _ in range(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).where("doc_id < 150")
    got = importance.importance_resample(df, labels, keep=0.6).collect()
    kept = [r.doc_id for r in got if r.kept]
    assert len(kept) == 180 and all(i % 3 for i in kept)
    same = spark.createDataFrame([(None, "good fine")] * 90 + [(7, "good fine")] * 90, "doc_id long, text string")
    assert sum(r.kept for r in importance.importance_resample(same, labels, keep=0.3).collect()) == 54
    assert importance.importance_resample(odd, labels).count() == 11
    assert importance.importance_resample(empty, labels).collect() == []


# -- long texts are read in parts


def test_parts_of_long_texts(spark, monkeypatch):
    rng = random.Random(31)
    texts = ["".join(rng.choice(["ab", "cd ", "é", "日本", " ", "\n", "'s", "12", ". ", "  ", "Xy "]) for _ in range(900)) for _ in range(6)] + ["a" * 5000, "x " * 2000 + "y" * 3000, "<|endoftext|>".join(["one two three " * 80] * 3)]
    column = pa.array(texts)

    def sets():
        return [x.tolist() for _, _, data, offsets in kernels.slices(column, kernels.SLICE_BYTES) for x in kernels.shingle_sets(data, offsets, 4)]

    def ids():
        return [ids[a:b].tolist() for ids, offsets in tokens.Encoder(tokens.tokenizer_path()).batches(column) for a, b in zip(offsets[:-1], offsets[1:])]

    def counts():
        return next(importance._counts(iter([pa.record_batch([column, pa.array([i % 3 for i in range(len(texts))])], names=["t", "m"])]))).to_pydict()

    def languages():
        (batch,) = language._sets(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(["x"] * len(texts)), column], names=["id", "lang", "text"])]))
        return batch.column(2).to_pylist()

    whole = sets(), ids(), counts(), languages()
    assert whole[1] == library(texts)
    payloads = [flac.padded(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    media = flac.encode_all(payloads)
    monkeypatch.setattr(kernels, "SLICE_BYTES", 256)
    monkeypatch.setattr(language, "SLICE", 256)
    monkeypatch.setattr(flac, "SLICE", 2048)
    monkeypatch.setattr(kernels.slices, "__defaults__", (256,))
    assert (sets(), ids(), counts(), languages()) == whole
    assert flac.encode_all(payloads) == media
    for p, (samples, _, good, md5) in zip(payloads, flac.decode_all(media)):
        assert ((samples[:, 0] + 128).astype(np.uint8) == p).all() and good.all() and md5


# -- all


def test_word_hashes_tell_words_apart():
    data = np.frombuffer(b"ab ba Ab abc ab", np.uint8)
    s, e, at = kernels.words(data, np.array([0, len(data)]))
    h = kernels.word_hashes(data, s, e)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3 and at.tolist() == [0, 5]


@needs_tables
def test_registered(spark):
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")] == list(range(1, 11))
    contract = {
        2: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", 3: "doc_id n_bytes n_tokens over_limit",
        5: "page_id url text n_chars", 7: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 8: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }
    for name, query in queries.QUERIES.items():
        want = contract.get(int(name[2:].split("_")[0])) if name.startswith("op") else None
        if want:
            assert set(want.split()) <= set(query(spark, SF).columns)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = rows.select("doc_id").distinct().count()
        rows = common.staged(stage(spark, rows, SF), "stage")
        assert rows.columns == columns and 0 < rows.select("doc_id").distinct().count() <= before
    assert not any("@" in r.text and brute_spans(r.text) for r in rows.collect())
    one = [(r.doc_id, r.text) for r in docs.collect()]
    reps = set(brute_components(one, 5, 80, 100)[0].values())
    assert {r.doc_id for r in rows.collect()} <= reps
    out = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    check = collections.Counter(r.doc_id for r in out if r.piece == 0)
    assert check == collections.Counter(r.doc_id for r in rows.collect())
