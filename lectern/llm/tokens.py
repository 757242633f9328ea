"""Token ids of many texts at once, as the tokenizers library gives them.

A byte-level BPE encodes each pre-token alone, so equal pre-tokens have equal ids. Pre-tokens of a
slice of texts are found by array arithmetic, looked up by a 64-bit hash in a direct-mapped cache of
fixed size, and only those not in it are encoded, by the library itself. Texts are cut at the strings of added
tokens, and long ones between pre-tokens. Tokenizers of any other build get whole texts.

Two different pre-tokens with one hash would be taken for each other: a chance of 1 / 2^64 for a pre-token and an
entry of the cache, 1e-13 for each look-up.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from . import kernels

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of the cache of pre-tokens (in two ways), and ids that an entry holds; longer pre-tokens are encoded each time.
CACHE, WIDTH = 1 << 20, 8
#: Bytes of text that are encoded together, about: the arrays of a slice take some 80 times as much.
SLICE = 1 << 17
_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN = range(5)


class Encoder:
    """Ids of texts under one tokenizers file, without added begin or end tokens.

    ``special``: whether the strings of added tokens in a text are these tokens; else they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec["model"].get("dropout")
        tokens = spec.get("added_tokens", [])
        self.plain &= not any(t.get(flag) for t in tokens for flag in ("lstrip", "rstrip", "single_word"))
        self.added = {t["content"].encode(): t["id"] for t in tokens} if special else {}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        self._make_cache(self.tokenizer.get_vocab_size())

    def _make_cache(self, vocabulary: int, width: int = WIDTH) -> None:
        self.width = width
        self.keys = np.zeros(CACHE, np.uint64)
        self.lengths = np.zeros(CACHE, np.uint8)
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.int32
        self.ids = np.zeros((CACHE, width), self.kind)
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.codes = np.zeros(0x110000, np.uint64)

    def _learn(self, points: np.ndarray) -> None:
        """The class of code points, as the library's own pre-tokenizer shows it."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in np.unique(points).tolist():
            c = chr(p)
            self.classes[p] = next((k for k, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(split(before + c)) == 1), _SPACE)
        self.codes[points] = kernels.mix(points.astype(np.uint64) + np.uint64(0x1234567))

    def _starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The first code points of all pre-tokens. begins: marks the first one of each text."""
        kind = self.classes[points]
        if (kind == _UNKNOWN).any():
            self._learn(points[kind == _UNKNOWN])
            kind = self.classes[points]
        start = begins.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last white space before a word is a pre-token's first code point; a blank joins the word.
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~begins[1:])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll
        n = len(points)
        quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & ~begins[1:])
        if len(quote):
            a = points[quote + 1]
            b = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
            b = np.where((quote + 2 < n) & ~begins[np.minimum(quote + 2, n - 1)], b, 0)
            one = np.isin(a, [115, 116, 109, 100])
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            start[quote[one | two] + 1] = False
            after = np.concatenate([quote[one] + 2, quote[two] + 3])
            after = after[after < n]
            after = after[(kind[after] == _LETTER) & ~begins[after]]
            start[after] = True
        return np.flatnonzero(start)

    def _encoded(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _look_up(self, text: str, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Lengths and rows of ids of pre-tokens, and the ids of those that are longer than a row."""
        slot = (hashes % np.uint64(CACHE)).astype(np.int64)
        hit = self.keys[slot] == hashes
        other = np.flatnonzero(~hit)
        second = slot[other] ^ ((hashes[other] >> np.uint64(40)) | np.uint64(1)).astype(np.int64) % CACHE
        found = self.keys[second] == hashes[other]
        slot[other[found]] = second[found]
        lengths, rows, long = self.lengths[slot].astype(np.int64), self.ids[slot], {}
        miss, second = other[~found], second[~found]
        if len(miss):
            _, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            at = miss[first]
            got = self._encoded([text[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())])
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum()))
            row = np.repeat(np.arange(len(got)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            table = np.zeros((len(got), self.width), self.kind)
            table[row[place < self.width], place[place < self.width]] = flat[place < self.width]
            lengths[miss], rows[miss] = sizes[back], table[back]
            # A new entry takes its first place if that is free, else its second.
            fits = sizes <= self.width
            put = np.where(self.keys[slot[at]] == 0, slot[at], second[first])[fits]
            self.keys[put], self.lengths[put], self.ids[put] = hashes[at[fits]], sizes[fits], table[fits]
            # Of entries put into one place, the last wrote all three arrays.
            if not fits.all():
                long = {int(i): got[j] for i, j in zip(miss, back) if not fits[j]}
        return lengths, rows, long

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        text = raw.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = heads[offsets]
        begins = np.zeros(len(points), bool)
        begins[at[:-1][at[:-1] < len(points)]] = True
        starts = self._starts(points, begins)
        stops = np.concatenate([starts[1:], [len(points)]])
        hashes = np.maximum(kernels.span_hashes(self.codes[points], starts, stops), np.uint64(1))  # 0 is an empty place
        lengths, rows, long = self._look_up(text, hashes, starts, stops)
        if long:
            repeats = np.maximum(1, -(-lengths // self.width))
            where = np.concatenate([[0], np.cumsum(repeats)])
            rows, parts = np.repeat(rows, repeats, 0), np.repeat(lengths, repeats)
            for i, ids in long.items():
                for k in range(0, len(ids), self.width):
                    part = ids[k : k + self.width]
                    rows[where[i] + k // self.width, : len(part)] = part
                    parts[where[i] + k // self.width] = len(part)
        else:
            parts = lengths
        flat = rows[np.arange(self.width) < parts[:, None]].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat, ends[np.searchsorted(starts, at)]

    def _long(self, raw: bytes) -> np.ndarray:
        """The ids of one text, cut between pre-tokens into parts of about a slice."""
        if not raw:
            return np.zeros(0, np.int32)
        budget = min(SLICE, kernels.SLICE_BYTES)
        if len(raw) <= budget:
            return self._slice(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        text = raw.decode()
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + budget)
            while end < len(text) and not self._between(text, end):
                end += 1
            out.append(self._slice(np.frombuffer(part := text[at:end].encode(), np.uint8), np.array([0, len(part)]))[0])
            at = end
        return np.concatenate(out)

    def _whole(self, raw: bytes) -> np.ndarray:
        """The ids of one text that may hold strings of added tokens."""
        if not self.plain:
            return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, np.int32)
        parts = self.split.split(raw) if self.split else [raw]
        return np.concatenate([np.array([self.added[p]], np.int32) if i % 2 else self._long(p) for i, p in enumerate(parts)])

    def batches(self, column: pa.Array, budget: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets by text) for consecutive slices of a string column, as ``kernels.slices`` cuts them; null counts as empty."""
        for _, _, data, offsets in kernels.slices(column, budget):
            if not len(data):
                yield np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
                continue
            raw = data.tobytes()
            whole = range(len(offsets) - 1)
            if self.plain and len(offsets) > 2:
                found = [m.start() for m in self.split.finditer(raw)] if self.split else []
                whole = set((np.searchsorted(offsets, found, "right") - 1).tolist())
            if not whole:
                yield self._slice(data, offsets)
                continue
            parts = []
            for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                parts.append(self._whole(raw[a:b]) if d in whole else self._long(raw[a:b]))
            yield np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    @staticmethod
    def _between(text: str, at: int) -> bool:
        """Whether a pre-token surely begins here: a blank or line feed between two others, or no letter, number or space after a letter."""
        c, before = text[at], text[at - 1]
        if c in " \n":
            return not before.isspace() and at + 1 < len(text) and not text[at + 1].isspace()
        return before.isalpha() and not c.isalnum() and not c.isnumeric() and not c.isspace()


class PieceEncoder(Encoder):
    """Ids of texts under one sentencepiece file, for texts that begin with the blank which the library would add.

    No piece has a blank after another character, so no merge crosses the place where blanks begin: texts are cut there, and equal parts
    have equal ids. A model with such pieces, or one that changes texts before, raises.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("a piece has a blank inside")
        if self.model.normalize(" \ufb01  a ") != "\u2581\u2581\ufb01\u2581\u2581a\u2581":
            raise ValueError("this model changes texts")
        self.plain, self.split, self.blank = True, None, pieces.index("\u2581")
        self._make_cache(len(pieces), 16)
        self.codes = np.zeros(0x110000, np.uint64)
        self.known = np.zeros(0x110000, bool)

    def _encoded(self, parts: list[str]) -> list[list[int]]:
        # The library adds no blank to nothing.
        return [[self.blank] if len(p) == 1 else ids for p, ids in zip(parts, self.model.encode([p[1:] for p in parts], num_threads=1))] if parts else []

    def _starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        new = points[~self.known[points]]
        if len(new):
            self.codes[new] = kernels.mix(new.astype(np.uint64) + np.uint64(0x7654321))
            self.known[new] = True
        blank = (points == 32) | (points == 0x2581)
        start = begins.copy()
        start[1:] |= blank[1:] & ~blank[:-1]
        return np.flatnonzero(start)

    @staticmethod
    def _between(text: str, at: int) -> bool:
        return text[at] == " " and text[at - 1] not in " \u2581"


def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder for each file and worker process."""
    make = (lambda: PieceEncoder(path)) if path.endswith(".model") else (lambda: Encoder(path, special))
    return kernels.held(("encoder", path, special), make)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
