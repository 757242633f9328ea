"""Removal of every byte under a string of ``length`` bytes that also starts somewhere else, by sorting suffixes.

A suffix of a document repeats if a neighbour in the sorted order of all suffixes shares its first ``length`` bytes.
Sorting every suffix would move each byte many times over, so there are two sorts, of few suffixes each:

1.  *Anchors.* Each string of ``length`` bytes has an anchor: the start inside it whose first ``GRAM`` bytes have the least hash (the first
    of equals). The anchor depends on the string's content only, so equal strings have it at the same place, and neighbouring strings
    mostly share it: there is one for some 65 bytes. The suffixes at anchors are sorted by their leading token, the hash of those
    ``GRAM`` bytes, and then by a token of all the bytes under the anchor's strings. A suffix that shares no leading token with
    a neighbour has no repeated string. If it shares both tokens, all its strings repeat. What is between is left
    to the second sort: the ragged ends of repeated passages.
2.  *Strings.* The suffixes at all strings of ragged anchors (one anchor for each distinct context) are sorted by two
    tokens, the hashes of the string's halves; a string repeats if a neighbour has both.

Both sorts are the same: splitters are sampled and suffixes are dealt to buckets by ranges of leading tokens (ties by document and
place, so that a hot passage fills several buckets), each bucket is sorted by multikey quicksort over token columns, neighbours
are compared, and the first and last runs of a bucket are compared with its neighbours' edges. Suffixes of one task that share all tokens
travel as one. Tokens are 64-bit hashes, so two different strings are taken as equal with 1 / 2^128 for each pair.

Equal texts are told by digest: all their bytes repeat, whatever else there is, and only one text of each digest is looked up again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernels
from .common import Scratch

#: Part of a string that an anchor's leading token covers (of ``length``), and suffixes that a bucket has, about.
GRAM, BUCKET = 0.68, 1 << 20
#: Suffixes that a task holds before equal ones become one, and starts of a long text that are looked at together.
HELD, PART = 1 << 20, 1 << 19
#: Digests that a task remembers, so as not to look at a text again.
SEEN = 1 << 18
#: Ranges that are finished by a plain sort.
SMALL = 1 << 14

#: Suffixes: two tokens, document, first start (above a bit: whether it stands for several), starts; without tokens, starts known to repeat.
_FOUND = "t0 long, t1 long, doc {}, at long, n int"


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their tokens: three-way partitions by one token; only equal parts go on to the next."""
    order = np.arange(len(tokens[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, k = stack.pop()
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort([t[part] for t in tokens[k:][::-1]])]
            continue
        key = tokens[k][part]
        some = np.sort(key[:: max(1, len(key) // 255)])
        pivot = some[len(some) // 2]
        less, more = key < pivot, key > pivot
        a, b = int(less.sum()), len(key) - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        stack += [(lo, lo + a, k), (lo + b, hi, k)]
        if k + 1 < len(tokens):
            stack.append((lo + a, lo + b, k + 1))
    return order


def _token(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return kernels.mix((sums[b] - sums[a]) * down[a])


def _summed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = kernels.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(kernels._BYTE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` neighbours, in two passes."""
    rows = np.concatenate([v, np.full(-len(v) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(v) - w + 1], ahead[w - 1 : len(v)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(document, first start, starts, leading token, context token) of the runs of strings that share an anchor."""
    if len(data) < length:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums, down = _summed(data)
    at = np.arange(len(data) - gram + 1)
    lead = _token(sums, down, at, at + gram)
    low = np.uint64((1 << 24) - 1)
    place = (_sliding_least((lead & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    start = np.arange(len(place))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = start + length <= offsets[doc + 1]
    start, place, doc = start[inside], place[inside], doc[inside]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])[: len(start)])
    last = np.concatenate([new[1:], [len(start)]])[: len(new)] - 1
    lo, hi, place, doc = start[new], start[last], place[new], doc[new]
    shape = kernels.mix(((hi - lo) << 20 | (place - lo)).astype(np.uint64))
    return doc, lo - offsets[doc], hi - lo + 1, lead[place], kernels.mix(_token(sums, down, lo, hi + length) ^ shape)


def _spans(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts, those that touch as one."""
    order = np.lexsort([s, doc])
    doc, s, n = doc[order], s[order], n[order]
    stop = s + n
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] > stop[:-1])])[: len(s)])
    ends = np.concatenate([new[1:], [len(s)]])[: len(new)] - 1
    return doc[new], s[new], stop[ends] - s[new]


class _Held:
    """Suffixes of a task; when there are enough, those that share all tokens become one, and their runs are known to repeat."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.parts, self.docs, self.n = kind, [], [], 0

    def add(self, docs: list, doc: np.ndarray, s: np.ndarray, n: np.ndarray, t0: np.ndarray, t1: np.ndarray):
        self.parts.append((doc + len(self.docs), s, n, t0, t1))
        self.docs += docs
        self.n += len(doc)

    def batch(self) -> pa.RecordBatch:
        doc, s, n, t0, t1 = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        keys = pa.array(self.docs, self.kind)
        self.__init__(self.kind)
        order = multikey_quicksort([t0, t1])
        new = np.flatnonzero(np.concatenate([[True], (t0[order][1:] != t0[order][:-1]) | (t1[order][1:] != t1[order][:-1])])[: len(order)])
        count = np.diff(np.concatenate([new, [len(order)]]))
        one, many = order[new], count > 1
        again = order[np.repeat(many, count)]
        own, first, runs = _spans(doc[again], s[again], n[again])
        ids, token = np.concatenate([doc[one], own]), lambda t: pa.concat_arrays([pa.array(t[one].view(np.int64)), pa.nulls(len(own), pa.int64())])
        at = np.concatenate([s[one] << 1 | many, first << 1])
        return pa.record_batch([token(t0), token(t1), keys.take(pa.array(ids)), pa.array(at), pa.array(np.concatenate([n[one], runs]).astype(np.int32))], names=["t0", "t1", "doc", "at", "n"])


def _anchored(length: int, gram: int):
    def run(batches):
        held, seen = _Held(pa.binary()), set()
        for batch in batches:
            # A copy of a text goes whole whatever it has, and one of them stands for all.
            new = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    new.append(i)
                    if len(seen) < SEEN:
                        seen.add(key)
            batch = batch.take(pa.array(new, pa.int64()))
            keys = batch.column(0)
            for i, j, data, offsets in kernels.slices(batch.column(1)):
                docs = keys.slice(i, j - i).to_pylist()
                for a in range(0, max(1, len(data) - length + 1), PART) if len(offsets) == 2 else (0,):
                    part = data[a : a + PART + length - 1] if len(offsets) == 2 else data
                    doc, s, *rest = anchors(part, offsets if len(offsets) > 2 else np.array([0, len(part)]), length, gram)
                    held.add(docs, doc, s + a, *rest)
                    if held.n >= HELD:
                        yield held.batch()
        yield held.batch()

    return run


def _strings(length: int):
    """Suffixes at the strings of some runs of starts of (number, text, s, n)."""
    def run(batches):
        held, half = _Held(pa.int64()), length // 2
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            raw = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
            begins = np.frombuffer(text.buffers()[1], np.int64)[text.offset :] if len(text) else np.zeros(0, np.int64)
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            s, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            docs = batch.column(0).to_pylist()
            cost = np.cumsum(n + length - 1)
            cuts = np.searchsorted(cost, np.arange(0, int(cost[-1]) if len(cost) else 0, PART))
            for a, b in zip(cuts, [*cuts[1:], len(s)]):
                if a == b:
                    continue
                d, p, m = doc[a:b], s[a:b], n[a:b]
                size = m + length - 1
                to = np.concatenate([[0], np.cumsum(size)])
                data = raw[np.repeat(begins[d] + p - to[:-1], size) + np.arange(to[-1])]
                sums, down = _summed(data)
                inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                at = np.repeat(to[:-1], m) + inner
                held.add(docs, np.repeat(d, m), np.repeat(p, m) + inner, np.ones(len(at), np.int64), _token(sums, down, at, at + half), _token(sums, down, at + half, at + length))
                if held.n >= HELD:
                    yield held.batch()
        yield held.batch()

    return run


_SORTED = "kind int, pid int, t0 long, t1 long, multi boolean, head boolean, tail boolean, below boolean, above boolean, doc {}, s long, n int"


def _bucket(batches):
    """One bucket, sorted and compared: repeated runs of starts (kind 0), suffixes to look at (1), those that wait for the edges (2), the edges (3, 4)."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    t0, t1 = (table.column(c).to_numpy() for c in (0, 1))  # signed, as the ranges are
    order = multikey_quicksort([t0, t1])
    t0, t1 = t0[order], t1[order]
    at = table.column(3).to_numpy()[order]
    many, doc, n = at & 1 > 0, table.column(2).combine_chunks(), table.column(4).to_numpy()[order]
    gram = t0[1:] == t0[:-1]
    same = gram & (t1[1:] == t1[:-1])
    head, tail = np.concatenate([[True], ~same]), np.concatenate([~same, [True]])
    run = np.cumsum(head) - 1
    multi = ((np.diff(np.concatenate([np.flatnonzero(head), [len(head)]])) > 1) | np.bitwise_or.reduceat(many, np.flatnonzero(head)))[run]
    below, above = head & np.concatenate([[False], gram]), tail & np.concatenate([gram, [False]])
    waits = (run == 0) | (run == run[-1])
    kind = np.where(waits, 2, np.where(multi, 0, np.where(below | above, 1, -1)))
    # A suffix that repeats may also stand for its context: a second row.
    extra = np.flatnonzero(~waits & multi & (below | above))
    rows = np.concatenate([np.flatnonzero(kind >= 0), extra, [0, len(head) - 1]])
    kinds = np.concatenate([kind[kind >= 0], np.ones(len(extra), int), [3, 4]])
    pid = TaskContext.get().partitionId()
    for a in range(0, len(rows), 1 << 16):
        r, k = rows[a : a + (1 << 16)], kinds[a : a + (1 << 16)].astype(np.int32)
        tokens = [pa.array(t[r], mask=k < 2) for t in (t0, t1)]
        flags = [pa.array(f[r], mask=k != 2) for f in (multi, head, tail, below, above)]
        yield pa.record_batch([pa.array(k), pa.array(np.full(len(r), pid, np.int32)), *tokens, *flags, doc.take(pa.array(order[r])), pa.array(at[r] >> 1), pa.array(n[r])], names=["kind", "pid", "t0", "t1", "multi", "head", "tail", "below", "above", "doc", "s", "n"])


_RUN = ["doc", "s", "n"]


def _neighbours(scratch: Scratch, found: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repeated, ragged, table): runs (doc, s, n) all of whose strings repeat, and runs that share a leading token with another only; the table to drop then."""
    suffixes = found.where("t0 is not null")
    buckets = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // BUCKET))
    dealt = suffixes.repartitionByRange(buckets, "t0", "t1", "doc", "at")
    ordered = scratch.stage(dealt.mapInArrow(kernels.tidy(_bucket), _SORTED.format(dict(found.dtypes)["doc"])), label)
    # Two rows for each bucket: as many as the splitters that Spark keeps itself.
    edges: dict[int, dict[int, tuple]] = {}
    for row in ordered.where("kind >= 3").select("pid", "kind", "t0", "t1").collect():
        edges.setdefault(row.pid, {})[row.kind] = (row.t0, row.t1)
    pids = sorted(edges)
    beside = [(p, *(edges[a][4] if a is not None else (None, None)), *(edges[b][3] if b is not None else (None, None))) for a, p, b in zip([None, *pids], pids, [*pids[1:], None])]
    known = scratch.spark.createDataFrame(beside, "pid int, p0 long, p1 long, q0 long, q1 long")
    waits = ordered.where("kind = 2").join(F.broadcast(known), "pid")
    first, last = F.struct("t0", "t1") == F.struct("p0", "p1"), F.struct("t0", "t1") == F.struct("q0", "q1")
    # Only a bucket's own first and last runs can meet its neighbours' edges.
    waits = waits.select("doc", "s", "n", "multi", "head", "tail", "below", "above", F.coalesce(first, F.lit(False)).alias("on"), F.coalesce(last, F.lit(False)).alias("off"), F.coalesce(F.col("t0") == F.col("p0"), F.lit(False)).alias("g"), F.coalesce(F.col("t0") == F.col("q0"), F.lit(False)).alias("h"))
    repeats = F.col("multi") | F.col("on") | F.col("off")
    ragged = (F.col("head") & ~F.col("on") & (F.col("below") | F.col("g"))) | (F.col("tail") & ~F.col("off") & (F.col("above") | F.col("h")))
    known = found.where("t0 is null").select("doc", F.shiftright("at", 1).alias("s"), "n")
    repeated = known.unionByName(ordered.where("kind = 0").select(_RUN)).unionByName(waits.where(repeats).select(_RUN))
    return repeated, ordered.where("kind = 1").select(_RUN).unionByName(waits.where(ragged).select(_RUN)), ordered


def _kept(length: int):
    def run(batches):
        for batch in batches:
            removed, kept = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))
            for (whole, starts, counts), text in zip(rows, batch.column(1)):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                if whole:
                    starts, counts = ([0], [len(raw) - length + 1]) if len(raw) >= length else ([], [])
                spans, at, out = [], 0, []
                for s, n in sorted(zip(starts or [], counts or [])):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s + n + length - 1)
                    else:
                        spans.append([s, s + n + length - 1])
                for a, b in spans:
                    out.append(raw[at:a].tobytes())
                    at = b
                out.append(raw[at:].tobytes())
                kept.append(b"".join(out))
                removed.append([{"start": a, "stop": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)], pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return run


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id_col, n_bytes, spans, kept) of every row: the byte ranges that go (maximal, from start to before stop), and the bytes that stay.

    Every byte goes that lies under ``length`` bytes which also start anywhere else, in another row or in the same one;
    strings are judged on the texts as they are, not on what stays. Matches never cross rows. A null text counts as
    empty; a text of fewer bytes stays whole. Rows that are equal in id and text are different rows, which repeat each other. Ids may
    repeat or be null. Other columns are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "repeats")
    gram = max(1, int(length * GRAM))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.substring(F.unhex(F.sha2("text", 256)), 1, 16)).withColumn("place", F.xxhash64(F.col("id").cast("string")))
    distinct = scratch.stage(rows.where(F.octet_length("text") >= length).groupBy("doc").agg(F.count("*").alias("copies"), F.min("place").alias("place")), "digests")

    long_ = rows.where(F.octet_length("text") >= length)
    found = scratch.stage(long_.select("doc", "text").mapInArrow(kernels.tidy(_anchored(length, gram)), _FOUND.format("binary")), "anchors")
    repeated, ragged, ordered = _neighbours(scratch, found, "sorted")
    runs = F.sort_array(F.collect_list(F.struct("s", "n"))).alias("runs")
    # One text of each digest is looked up again; its runs come to it, not to its copies. It gets a number, shorter than its digest.
    asked = ragged.distinct().groupBy("doc").agg(runs).join(distinct, "doc").withColumn("number", F.monotonically_increasing_id())
    asked = scratch.stage(asked.select("number", "doc", "place", "copies", "runs"), "ragged")
    first = scratch.stage(repeated.join(distinct.where("copies = 1").select("doc"), "doc", "left_semi"), "repeated")
    scratch.drop(found, ordered)
    texts = long_.select("doc", "place", "text").join(asked.hint("shuffle_hash"), ["doc", "place"]).select("number", "text", F.transform("runs", lambda x: x["s"]).alias("s"), F.transform("runs", lambda x: x["n"]).alias("n"))
    strings = scratch.stage(texts.mapInArrow(kernels.tidy(_strings(length)), _FOUND.format("long")), "strings")
    repeated, _, ordered = _neighbours(scratch, strings, "sorted")
    second = repeated.groupBy("doc").agg(runs).withColumnRenamed("doc", "number").join(asked.where("copies = 1").select("number", "doc"), "number").select("doc", "runs")
    second = scratch.stage(second, "more")
    scratch.drop(strings, ordered)

    spans = first.groupBy("doc").agg(runs).unionByName(second).groupBy("doc").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    found = scratch.stage(distinct.where("copies = 1").select("doc", "place").join(spans, "doc", "left"), "spans")
    # A row that is not the only one of its digest finds nothing here, and goes whole if it is long enough.
    out = rows.select("id", "text", "doc", "place").join(found.withColumn("known", F.lit(True)).hint("shuffle_hash"), ["doc", "place"], "left")
    out = out.select("id", "text", F.col("known").isNull().alias("whole"), F.transform("runs", lambda x: x["s"]).alias("s"), F.transform("runs", lambda x: x["n"]).alias("n"))
    kind = dict(df.dtypes)[id_col]
    made = out.mapInArrow(kernels.tidy(_kept(length)), f"id {kind}, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return made.withColumnRenamed("id", id_col)
