"""NumPy kernels over the bytes of many texts at once.

Texts arrive as an Arrow string column. A slice of it is one byte array with
document offsets; words, hashes and shingles are found by array arithmetic, so
no Python object is made per word. Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8
bytes, which is the same as on code points, since all separators are ASCII.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


_held: dict = {}


def held(key, make):
    """What a worker keeps from task to task, made once."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Drop what ``held`` keeps. A task calls this function and never names ``_held``: the task is pickled with a copy of the values that it names."""
    if _held:
        _held.clear()
        trim()


def tidy(run, keep: bool = False):
    """A task that begins without what other operators hold in this worker (unless ``keep``) and returns its free memory at the end."""
    def task(batches):
        if not keep:
            forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def trim() -> None:
    """Free memory goes back: that of Arrow's own pool too, which keeps freed batches."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[key] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] |= word[begins]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= word[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def span_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (random odd 64-bit codes of the symbols)."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hashes((_BYTE_LOWER if lower else _BYTE)[data], starts, stops)


_LANES = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbours (ignoring document ends); k <= 5."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _LANES[0]
    for i in range(1, k):
        total = total + hashes[i : n + i] * _LANES[i]
    return mix(total + np.uint64(k))


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and for each document the index of its first word (one more at the end).

    A text longer than a slice is hashed in parts of ``SLICE_BYTES``; a word across parts has the hash it would have
    in one, so memory beyond the result stays that of a part.
    """
    if len(data) <= SLICE_BYTES:
        starts, stops, at = words(data, offsets)
        return word_hashes(data, starts, stops, lower), at
    if len(offsets) != 2:
        parts = [hashed_words(data[a:b], np.array([0, b - a]), lower)[0] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    codes = _BYTE_LOWER if lower else _BYTE
    out, mask = [], (1 << 64) - 1
    open_sum, open_at = 0, None  # of a word that has begun in an earlier part: its sum, and where it began
    for a in range(0, len(data), SLICE_BYTES):
        part = data[a : a + SLICE_BYTES]
        starts, stops, _ = words(part, np.array([0, len(part)]))
        if not len(starts):
            if open_at is not None:
                out.append(mix(np.array([open_sum], np.uint64)))
                open_at = None
            continue
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * up[: len(part)], out=sums[1:])
        raw = (sums[stops] - sums[starts]) * down[starts]
        if open_at is not None:
            if starts[0] == 0:  # the word goes on
                raw[0] = np.uint64((open_sum + int(raw[0]) * pow(_MULTIPLIER, a - open_at, 1 << 64)) & mask)
            else:
                out.append(mix(np.array([open_sum], np.uint64)))
                open_at = None
        if stops[-1] == len(part) and a + len(part) < len(data):
            open_at = open_at if open_at is not None and len(raw) == 1 and starts[0] == 0 else a + int(starts[-1])
            open_sum = int(raw[-1])
            raw = raw[:-1]
        else:
            open_at = None
        out.append(mix(raw))
    if open_at is not None:
        out.append(mix(np.array([open_sum], np.uint64)))
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return hashes, np.array([0, len(hashes)])


def _distinct_runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``k`` neighbours, in parts of bounded size."""
    n, step = len(hashes) - k + 1, SLICE_BYTES
    if n <= step:
        return np.unique(runs(hashes, k))
    found = [np.unique(runs(hashes[i : i + step + k - 1], k)) for i in range(0, n, step)]
    while len(found) > 1:
        found = [np.union1d(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles (A-Z lower-cased).

    A document of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    hashes, at = hashed_words(data, offsets)
    if len(offsets) == 2:
        yield _distinct_runs(hashes, k) if len(hashes) >= k else runs(hashes, len(hashes)) if len(hashes) else hashes
        return
    full = runs(hashes, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            yield runs(hashes[a:b], b - a)
        else:
            yield full[:0]
