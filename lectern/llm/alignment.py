"""Alignment of two tokenizers' tokens over the same bytes, and counts of the pairs of ids that it links.

A text is encoded by both; each token covers a range of bytes. Offsets where tokens of both end cut a text into groups; between
neighbouring ends of either lies one pair of overlapping tokens, so a text has as many links as distinct ends.

The count of a pair of ids is the number of texts that hold it linked. A pair is one packed 64-bit key (the first id above
the second); a task makes its texts' keys distinct and adds them up by ``np.unique``, and sends partial counts. These are sorted globally
by range, runs of one key are summed as they pass, and each range becomes a shard: sorted keys and their counts in one file in the
shared folder, which Spark hands to each executor. There, workers map the shards into memory and look links up by ``np.searchsorted``.
There are at most as many keys as pairs of ids, whatever the input.

Texts are encoded once: their ids are kept in a table between the two passes.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernels
from .common import Scratch
from .tokens import PieceEncoder, encoder

#: Distinct keys that a task holds before it sends their counts, and links that are looked at together.
HELD, LINKS = 1 << 21, 1 << 19


class Vocabulary:
    """The bytes of each id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.bits = max(1, (len(tokens) - 1).bit_length())
        self.kind = np.dtype("<u2") if len(tokens) <= 1 << 16 else np.dtype("<u4")
        self.digits = np.array([list(str(i).rjust(7).encode()) for i in range(len(tokens))], np.uint8)
        self.width = np.array([len(str(i)) for i in range(len(tokens))], np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _byte_of() -> dict[str, int]:
    """Byte-level alphabets write a byte that is a visible character as itself, and the others as the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}


def vocabulary(path: str) -> Vocabulary:
    """The bytes of the tokens of a byte-level BPE (.json) or of pieces (.model), once for each worker process."""
    def read() -> Vocabulary:
        enc = encoder(path, False)
        if isinstance(enc, PieceEncoder):
            pieces = [enc.model.id_to_piece(i) for i in range(enc.model.get_piece_size())]
            raw = lambda i, p: bytes([int(p[3:5], 16)]) if enc.model.is_byte(i) and re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
            return Vocabulary([raw(i, p) for i, p in enumerate(pieces)])
        of, tok = _byte_of(), enc.tokenizer
        tokens = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
        return Vocabulary([bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens])

    return kernels.held(("vocabulary", path), read)


def _same(own: Vocabulary, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text's tokens, joined, are the text."""
    total = np.concatenate([[0], np.cumsum(own.sizes[ids])])[at]
    fits = np.diff(total) == np.diff(offsets)
    if fits.all():
        wrong = np.concatenate([[0], np.cumsum(own.joined(ids) != data)])
        return wrong[offsets[1:]] == wrong[offsets[:-1]]
    out = np.zeros(len(fits), bool)
    for d in np.flatnonzero(fits):
        out[d] = np.array_equal(own.joined(ids[at[d] : at[d + 1]]), data[offsets[d] : offsets[d + 1]])
    return out


def _links(a: Vocabulary, b: Vocabulary, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, end, shared, place in A, place in B) of all links over texts laid end to end; ``shared``: whether a group ends there, too."""
    ea, eb = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    n = int(ea[-1]) if len(ea) else 0
    mark = np.zeros(n + 1, np.uint8)
    mark[ea] += 1
    mark[eb] += 2
    end = np.flatnonzero(mark)
    shared = mark[end] == 3
    # A link's tokens are the first to end at its end or after it: as many end before as there are ends of either to its left.
    in_a, in_b = (mark[end] & 1).astype(np.int64), (mark[end] >> 1).astype(np.int64)
    ia, ib = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    return ids_a[ia].astype(np.int64) << b.bits | ids_b[ib].astype(np.int64), end, shared, ia, ib


def _parts(a: Vocabulary, b: Vocabulary, ids_a: np.ndarray, ids_b: np.ndarray):
    """The tokens of one long text in parts of about ``LINKS``, cut where tokens of both end."""
    if len(ids_a) + len(ids_b) <= LINKS:
        yield ids_a, ids_b
        return
    ea, eb = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
    i = j = 0
    while i < len(ids_a):
        k = min(len(ids_a), i + LINKS // 2) - 1
        while k < len(ids_a) - 1 and eb[np.searchsorted(eb, ea[k])] != ea[k]:
            k += 1
        m = int(np.searchsorted(eb, ea[k])) + 1
        yield ids_a[i : k + 1], ids_b[j:m]
        i, j = k + 1, m


def _distinct_keys(a: Vocabulary, b: Vocabulary, ids_a: np.ndarray, ids_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The keys of each text, once for each; ``sizes``: the bytes of the texts."""
    if len(sizes) == 1:
        found = [np.unique(_links(a, b, x, y)[0]) for x, y in _parts(a, b, ids_a, ids_b)] if len(ids_a) else []
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    key, end, *_ = _links(a, b, ids_a, ids_b)
    bits = a.bits + b.bits  # which text, above the key: one sort for all
    return np.unique(np.searchsorted(np.cumsum(sizes), end, "left") << bits | key) & ((np.int64(1) << bits) - 1)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[new], np.add.reduceat(count, new) if len(new) else count


def _encoded(path_a: str, path_b: str):
    """Rows (id, a, b) with the ids of each text, and rows (key, n) with the partial counts of this task."""
    def run(batches):
        enc_a, enc_b, a, b = encoder(path_a, False), encoder(path_b), vocabulary(path_a), vocabulary(path_b)
        keys, counts, held = [], [], 0

        def sent(own):
            key, count = _summed(keys, counts)
            for i in range(0, len(key), 1 << 16):
                part = pa.array(key[i : i + (1 << 16)])
                yield pa.record_batch([pa.nulls(len(part), own), *(pa.nulls(len(part), pa.binary()),) * 2, part, pa.array(count[i : i + (1 << 16)])], names=["id", "a", "b", "key", "n"])

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            column = batch.column(1)
            for (i, j, data, offsets), (ids_a, at_a), (ids_b, at_b) in zip(kernels.slices(column), enc_a.batches(column, kernels.SLICE_BYTES), enc_b.batches(column, kernels.SLICE_BYTES)):
                good = _same(a, ids_a, at_a, data, offsets) & _same(b, ids_b, at_b, data, offsets)
                na, nb = np.diff(at_a), np.diff(at_b)
                if not good.all():
                    ids_a, ids_b = ids_a[np.repeat(good, na)], ids_b[np.repeat(good, nb)]
                    na, nb = na * good, nb * good
                key, count = np.unique(_distinct_keys(a, b, ids_a, ids_b, np.diff(offsets) * good), return_counts=True)
                keys.append(key)
                counts.append(count)
                held += len(key)
                rows = []
                for ids, n, kind_of in ((ids_a, na, a.kind), (ids_b, nb, b.kind)):
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * kind_of.itemsize
                    raw = pa.py_buffer(ids.astype(kind_of).tobytes())
                    rows.append(pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), raw]).cast(pa.binary()))
                none = pa.nulls(len(na), pa.int64())
                yield pa.record_batch([batch.column(0).slice(i, j - i), *rows, none, none], names=["id", "a", "b", "key", "n"])
                if held > HELD:
                    key, count = _summed(keys, counts)
                    keys, counts, held = [key], [count], len(key)
                    if held > HELD // 2:
                        yield from sent(kind)
                        keys, counts, held = [], [], 0
        yield from sent(kind)

    return run


def _shards(folder: str):
    """Rows (key, n) in order: runs of a key are summed as they pass, and the range becomes one file, keys before counts."""
    def run(batches):
        keys, counts, last = [], [], None
        for batch in batches:
            key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if not len(key):
                continue
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, n = key[new], np.add.reduceat(n, new)
            if last is not None and key[0] == last:  # the run goes on
                counts[-1][-1] += n[0]
                key, n = key[1:], n[1:]
            if len(key):
                keys.append(key)
                counts.append(n)
                last = key[-1]
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(counts)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        name = f"{os.path.basename(base)}-{TaskContext.get().partitionId()}"
        # A second attempt writes the same bytes; a file is there only when it is whole.
        part = f"{base}/{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(key.astype("<i8").tobytes())
            out.write(n.astype("<i8").tobytes())
        store.move(part, f"{base}/{name}")
        yield pa.record_batch([pa.array([name]), pa.array([len(key)], pa.int64()), pa.array([int(key[0])], pa.int64())], names=["name", "rows", "first"])

    return run


class _Counts:
    """Shards mapped into memory, and the highest count of each first id."""

    def __init__(self, shards: list[tuple[str, int, int]], bits: int, ids: int):
        self.first = np.array([first for _, _, first in shards], np.int64)
        maps = [np.memmap(SparkFiles.get(name), "<i8", "r", shape=(2, rows)) for name, rows, _ in shards]
        self.keys, self.counts = [m[0] for m in maps], [m[1] for m in maps]
        self.most = np.zeros(ids, np.int64)
        for key, count in zip(self.keys, self.counts):
            for i in range(0, len(key), 1 << 20):
                np.maximum.at(self.most, key[i : i + (1 << 20)] >> bits, count[i : i + (1 << 20)])

    def of(self, key: np.ndarray) -> np.ndarray:
        shard = np.searchsorted(self.first, key, "right") - 1
        out = np.empty(len(key), np.int64)
        for i in np.unique(shard):
            own = np.flatnonzero(shard == i)
            out[own] = self.counts[i][np.searchsorted(self.keys[i], key[own])]
        return out


def _written(a: Vocabulary, b: Vocabulary, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, texts_a: np.ndarray, texts_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Groups of all texts as ``a1,a2|b1;...``, and where each text's part ends. group_*: the number of each token's group."""
    na, nb = len(ids_a), len(ids_b)
    groups = int(group_a[-1]) + 1 if na else 0
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    place = np.concatenate([np.arange(na) + before_b[group_a], np.arange(nb) + (before_a + size_a)[group_b]])
    width, digits, mark = np.empty(na + nb, np.int64), np.empty((na + nb, 7), np.uint8), np.full(na + nb, ord(","), np.uint8)
    width[place] = np.concatenate([a.width[ids_a], b.width[ids_b]])
    digits[place] = np.concatenate([a.digits[ids_a], b.digits[ids_b]])
    mark[before_b + before_a + size_a - 1] = ord("|")
    mark[before_b + before_a + size_a + size_b - 1] = ord(";")
    ends = np.cumsum(width + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = mark
    for k in range(1, int(width.max(initial=0)) + 1):
        has = width >= k
        out[(ends - 1 - k)[has]] = digits[has, 7 - k]
    stops = np.concatenate([[0], ends])[np.cumsum(texts_a) + np.cumsum(texts_b)]
    return out.tobytes(), stops


def _aligned(path_a: str, path_b: str, shards):
    def run(batches):
        a, b = vocabulary(path_a), vocabulary(path_b)
        listed = shards.value
        counts = kernels.held(("counts", tuple(listed)), lambda: _Counts(listed, b.bits, len(a.sizes)))
        for batch in batches:
            raw = [[x.as_buffer() if x.is_valid else b"" for x in batch.column(c)] for c in (1, 2)]
            sizes = np.array([len(x) // a.kind.itemsize + len(y) // b.kind.itemsize for x, y in zip(*raw)], np.int64)
            cuts = [0]
            while cuts[-1] < len(sizes):
                ahead = np.cumsum(sizes[cuts[-1] :])
                cuts.append(cuts[-1] + max(1, int(np.searchsorted(ahead, LINKS, "right"))))
            for i, j in zip(cuts[:-1], cuts[1:]):
                texts = [np.frombuffer(x, a.kind) for x in raw[0][i:j]], [np.frombuffer(x, b.kind) for x in raw[1][i:j]]
                if j == i + 1:  # may be long
                    sums, digest = np.zeros((6, 1), np.int64), hashlib.sha256()
                    for x, y in _parts(a, b, texts[0][0], texts[1][0]):
                        more, (written,) = _numbers(a, b, counts, [x], [y])
                        digest.update(b";" * bool(sums[2, 0]) + written)
                        sums += more
                    digests = [digest.hexdigest() if sums[2, 0] else ""]
                else:
                    sums, written = _numbers(a, b, counts, *texts)
                    digests = [hashlib.sha256(w).hexdigest() if w else "" for w in written]
                yield pa.record_batch([batch.column(0).slice(i, j - i), *map(pa.array, sums), pa.array(digests, pa.string())], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def _numbers(a: Vocabulary, b: Vocabulary, counts: _Counts, texts_a: list[np.ndarray], texts_b: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """The six numbers of each text, and its groups as written."""
    na, nb = (np.array([len(x) for x in texts], np.int64) for texts in (texts_a, texts_b))
    ids_a, ids_b = np.concatenate(texts_a), np.concatenate(texts_b)
    key, end, shared, ia, ib = _links(a, b, ids_a, ids_b)
    group = np.cumsum(shared) - shared  # of each link
    last_a, last_b = np.concatenate([ia[1:] != ia[:-1], [True]])[: len(ia)], np.concatenate([ib[1:] != ib[:-1], [True]])[: len(ib)]
    written, stops = _written(a, b, ids_a, ids_b, group[last_a], group[last_b], na, nb)
    begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    count = counts.of(key) if len(key) else np.zeros(0, np.int64)
    best = count == counts.most[key >> b.bits]
    # Links of a text: those that end at or before the end of its last token.
    bytes_ = np.concatenate([[0], np.cumsum(a.sizes[ids_a])])[np.cumsum(na)]
    at = np.concatenate([[0], np.searchsorted(end, bytes_, "right")])
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x.astype(np.int64))])[at])
    return np.array([na, nb, per(shared), np.diff(at), per(best), per(count)], np.int64), [written[x : max(x, y - 1)] for x, y in zip(begins.tolist(), stops.tolist())]


def pair_counts(scratch: Scratch, encoded: DataFrame) -> list[tuple[str, int, int]]:
    """(file, keys, first key) of the shards of all pair counts, in order; each executor gets the files from Spark."""
    spark = scratch.spark
    folder = f"{scratch.path}/pairs-{uuid.uuid4().hex[:12]}"
    counts = encoded.where("key is not null").select("key", "n")
    ordered = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    shards = scratch.stage(ordered.mapInArrow(kernels.tidy(_shards(folder)), "name string, rows long, first long"), "shards")
    listed = sorted(((r.name, r.rows, r.first) for r in shards.collect()), key=lambda s: s[2])  # a row for each shard
    for name, *_ in listed:
        spark.sparkContext.addFile(f"{folder}/{name}")
    return listed


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``df``.

    ``path_a`` is a byte-level BPE file and encodes a blank and the text, ``path_b`` is a sentencepiece file and
    encodes the text. A null or empty text, and one whose tokens of either side do not join to its bytes, has no tokens: zeros, an empty
    string, and no part in the counts. Equal rows are different texts and count twice. n_best: links whose pair has the highest count
    of its first id, ties included; count_sum: the sum of the counts of all links. Ids may repeat or be null. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "alignment")
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).alias("text"))
    kind = dict(df.dtypes)[id_col]
    encoded = scratch.stage(rows.mapInArrow(kernels.tidy(_encoded(path_a, path_b), keep=True), f"id {kind}, a binary, b binary, key long, n long"), "encoded")
    shards = spark.sparkContext.broadcast(pair_counts(scratch, encoded))
    made = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = encoded.where("key is null").select("id", "a", "b").mapInArrow(kernels.tidy(_aligned(path_a, path_b, shards), keep=True), made)
    return out.withColumnRenamed("id", id_col)
