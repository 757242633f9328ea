"""FLAC media columns: lossless encoding of 8-bit samples, and decoding of streams into seekable PCM blocks.

Encoder: mono, 8 bits, blocks of ``BLOCK`` samples; for each block the cheapest of constant, verbatim,
fixed predictors of order 0 to 2 and a quantised linear predictor, with one Rice partition; a seek point
for every block; MD5 of the samples.

Decoder: any stream of up to 8 channels and 24 bits of constant, verbatim, fixed and linear-predictor
subframes, Rice codes of both widths with partitions and escapes, and the three stereo decorrelations.
CRC-8 of frame headers, CRC-16 of frames and the MD5 of the samples are verified.

Many frames are decoded side by side: step i takes the next Rice code of every frame by array arithmetic, so
no Python object is made per sample. Frames are found by a complete seek table, else one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels

BLOCK = 1024
PAD = 64
ORDER, PRECISION, SHIFT = 4, 12, 10
#: Payload bytes that are encoded side by side, and points of a seek table, at most.
SLICE, POINTS = 1 << 21, 900_000
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc8_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = ((b << 1) ^ 0x07) & 0xFF if b & 0x80 else b << 1
        out.append(b)
    return out


def _crc16_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        b = i << 8
        for _ in range(8):
            b = ((b << 1) ^ 0x8005) & 0xFFFF if b & 0x8000 else (b << 1) & 0xFFFF
        out[i] = b
    return out


CRC8, CRC16 = _crc8_table(), _crc16_table()
_far = {"table": CRC16[None, :]}


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16_all(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC-16 of each span. A CRC is linear: the byte at distance d from the end adds its own table entry of d."""
    lengths = stops - starts
    need = int(lengths.max(initial=1))
    if len(_far["table"]) < need:
        rows = list(_far["table"])
        for _ in range(need - len(rows)):
            last = rows[-1]
            rows.append((last << np.uint16(8)) ^ CRC16[last >> np.uint16(8)])
        _far["table"] = np.stack(rows)
    out = np.zeros(len(starts), np.uint16)
    some = np.flatnonzero(lengths > 0)
    if len(some):
        n = lengths[some]
        heads = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(heads, n)
        distance = np.repeat(n, n) - 1 - at
        parts = _far["table"][distance, data[np.repeat(starts[some], n) + at]]
        out[some] = np.bitwise_xor.reduceat(parts, heads)
    return out


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1)), *tail])


_headers: dict[tuple[int, int], bytes] = {}


def _frame_header(number: int, size: int) -> bytes:
    if (number, size) not in _headers:
        head = b"\xff\xf8\x70\x02" + _utf8_number(number) + struct.pack(">H", size - 1)
        if len(_headers) > 1 << 16:
            _headers.clear()
        _headers[number, size] = head + bytes([crc8(head)])
    return _headers[number, size]


def _linear(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Quantised predictors of order ``ORDER`` for each row, by Levinson's recursion over all rows at once."""
    f = x.astype(np.float32)
    r = np.stack([(f[:, : f.shape[1] - i] * f[:, i:]).sum(1) for i in range(ORDER + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * (1 + 1e-6) + 1
    a = np.zeros((len(x), ORDER))
    error = r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error *= np.maximum(1 - k * k, 1e-9)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -limit, limit).astype(np.int32)


def _frames(chunks: list[np.ndarray], firsts: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """(frames, their sizes) of each run of samples; ``firsts``: the number of each run's first frame. All but the last
    block of a run are full."""
    counts = [-(-len(p) // BLOCK) for p in chunks]
    total = sum(counts)
    lengths = np.full(total, BLOCK, np.int64)
    ends = np.cumsum(counts)
    lengths[ends - 1] = [len(p) - (c - 1) * BLOCK for p, c in zip(chunks, counts)]
    number = np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(firsts, counts)
    inside = np.arange(BLOCK) < lengths[:, None]
    x = np.zeros((total, BLOCK), np.int32)
    x[inside] = np.concatenate(chunks).astype(np.int32) - 128

    # Residuals of all predictors; those of warm-up samples and behind the end are 0.
    coefficients = _linear(x, lengths)
    guess = np.zeros((total, BLOCK - ORDER), np.int32)
    for i in range(ORDER):
        guess += coefficients[:, i : i + 1] * x[:, ORDER - 1 - i : BLOCK - 1 - i]
    kinds = [x]
    for _ in range(2):
        kinds.append(np.diff(kinds[-1], axis=1, prepend=0))
    predicted = np.zeros_like(x)
    predicted[:, ORDER:] = x[:, ORDER:] - (guess >> SHIFT)
    kinds.append(predicted)
    orders = np.array([0, 1, 2, ORDER])
    cost = np.stack([np.abs(np.where(inside, k, 0)[:, o:]).sum(1) for k, o in zip(kinds, orders)], 1)
    cost[:, 3] += 40  # its coefficients
    best = cost.argmin(1)
    order = orders[best]
    residual = np.choose(best[:, None], kinds)
    coded = inside & (np.arange(BLOCK) >= order[:, None])
    u = np.where(coded, (residual << 1) ^ (residual >> 31), 0).astype(np.int32)
    n = coded.sum(1)
    bits = np.stack([(u >> k).sum(1) + n * (k + 1) for k in range(10)], 1)
    rice = bits.argmin(1)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(1)
    verbatim = ~constant & (bits.min(1) + 8 * order + 20 >= 8 * lengths)

    # Fields (value, width) of every subframe: a head of up to HEAD fields, then one for each sample.
    head = 2 + ORDER + 2 + ORDER + 1
    values, widths = np.zeros((total, head + BLOCK), np.int32), np.zeros((total, head + BLOCK), np.int32)
    plain = ~constant & ~verbatim
    linear = plain & (best == 3)
    values[:, 0] = np.where(constant, 0, np.where(verbatim, 2, np.where(linear, (32 | (ORDER - 1)) << 1, (8 | order) << 1)))
    widths[:, 0] = 8
    warm = np.where(constant, 1, np.where(verbatim, 0, order))
    for i in range(ORDER):
        on = warm > i
        values[on, 1 + i], widths[on, 1 + i] = x[on, i] & 255, 8
    at = 1 + ORDER
    values[linear, at], widths[linear, at] = ((PRECISION - 1) << 5) | SHIFT, 9
    for i in range(ORDER):
        values[linear, at + 1 + i], widths[linear, at + 1 + i] = coefficients[linear, i] & ((1 << PRECISION) - 1), PRECISION
    values[plain, head - 1], widths[plain, head - 1] = rice[plain], 10
    k = rice[:, None]
    code = coded & plain[:, None]
    values[:, head:] = np.where(code, (1 << k) | (u & ((1 << k) - 1)), 0)
    widths[:, head:] = np.where(code, (u >> k) + 1 + k, 0)
    raw = inside & verbatim[:, None]
    values[:, head:][raw], widths[:, head:][raw] = x[raw] & 255, 8

    heads = [_frame_header(i, s) for i, s in zip(number.tolist(), lengths.tolist())]
    head_size = np.array([len(h) for h in heads])
    body = widths.sum(1)
    frame_size = head_size + (body + 7) // 8 + 2
    frame_at = np.cumsum(frame_size) - frame_size
    out = np.zeros(int(frame_size.sum()), np.uint8)

    end = ((frame_at + head_size) * 8)[:, None] + np.cumsum(widths, 1)
    use = widths > 0
    end, value = end[use], values[use].astype(np.int64)
    byte = (end - 1) >> 3
    value <<= 7 - ((end - 1) & 7)
    base = int(byte[0]) - 3
    span = int(byte[-1]) - base + 1
    sums = sum(np.bincount(byte - base - i, (value >> (8 * i)) & 255, span) for i in range(3))
    out[base + 3 : base + span] += sums[3:].astype(np.uint8)
    for a, h in zip(frame_at.tolist(), heads):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    stops = frame_at + frame_size - 2
    crc = crc16_all(out, frame_at, stops)
    out[stops], out[stops + 1] = crc >> 8, crc & 255

    cuts = np.concatenate([[0], ends])
    bounds = np.concatenate([frame_at, [len(out)]])[cuts]
    return [(out[bounds[i] : bounds[i + 1]].tobytes(), frame_size[cuts[i] : cuts[i + 1]]) for i in range(len(chunks))]


def _stream(payload: np.ndarray, parts: list[tuple[bytes, np.ndarray]], rate: int) -> bytes:
    """Metadata and frames. A seek table holds 24 bits of bytes, so a very long stream has a point for every second block, or fewer."""
    sizes = np.concatenate([n for _, n in parts])
    c = len(sizes)
    packed = (rate << 44) | (0 << 41) | (7 << 36) | len(payload)
    digest = hashlib.md5()
    for i in range(0, len(payload), SLICE):
        digest.update((payload[i : i + SLICE] ^ 128).tobytes())
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + digest.digest()
    at = np.arange(0, c, -(-c // POINTS))
    seek = np.zeros(len(at), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
    seek["sample"], seek["offset"] = at * BLOCK, (np.cumsum(sizes) - sizes)[at]
    seek["samples"] = np.minimum(BLOCK, len(payload) - at * BLOCK)
    table = seek.tobytes()
    return b"".join([b"fLaC", b"\x00", (34).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *(p for p, _ in parts)])


def encode_all(payloads: list[np.ndarray], rate: int = 16000) -> list[bytes]:
    """A FLAC stream for each payload of unsigned 8-bit samples (none may be empty). About ``SLICE`` bytes are encoded side by side."""
    step = SLICE // BLOCK * BLOCK
    chunks = [(i, p[a : a + step], a // BLOCK) for i, p in enumerate(payloads) for a in range(0, len(p), step)]
    made: list[list] = [[] for _ in payloads]
    run, size = [], 0
    for k, chunk in enumerate(chunks):
        run.append(chunk)
        size += len(chunk[1])
        if size >= SLICE or k + 1 == len(chunks):
            for (i, _, _), part in zip(run, _frames([c for _, c, _ in run], [f for _, _, f in run])):
                made[i].append(part)
            run, size = [], 0
    return [_stream(p, parts, rate) for p, parts in zip(payloads, made)]


@dataclass
class Stream:
    """Metadata of a stream. ``frames`` are the byte offsets of all frames, where a complete seek table gives them."""

    channels: int
    bits: int
    total: int
    md5: bytes
    first: int
    block: int
    frames: list[int] | None
    samples: np.ndarray | None = None


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points, last = 4, None, None, False
    while not last:
        last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("truncated metadata")
        if kind == 0:
            info = body
        elif kind == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    stream = Stream((packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34], at, int.from_bytes(info[2:4], "big"), None)
    if points is not None and len(points):
        n = points["samples"].astype(np.int64)
        begin = points["sample"].astype(np.int64)
        if (begin == np.cumsum(n) - n).all() and n.sum() == stream.total:
            stream.frames = (points["offset"].astype(np.int64) + at).tolist()
    return stream


_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}


def read_header(data, at: int, stream: Stream) -> tuple[int, int, int, int]:
    """(bytes, block size, channel assignment, bits) of the frame header at ``at``; raises where it is not valid."""
    b = data[at : at + 16]
    if len(b) < 6 or b[0] != 0xFF or b[1] & 0xFE != 0xF8:
        raise ValueError("no frame")
    size_code, rate_code, assignment, depth = b[2] >> 4, b[2] & 15, b[3] >> 4, b[3] >> 1 & 7
    number = 1
    while b[4] & (0x80 >> number) and b[4] & 0x80:
        number += 1
    i = 4 + (number if b[4] & 0x80 else 1)
    if size_code == 6:
        size, i = b[i] + 1, i + 1
    elif size_code == 7:
        size, i = (b[i] << 8 | b[i + 1]) + 1, i + 2
    else:
        size = _SIZES[size_code]
    i += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(b[:i]) != b[i]:
        raise ValueError("CRC-8 of a frame header")
    return i + 1, size, assignment, {0: stream.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}[depth]


_ZEROS = np.array([16] + [15 - (i.bit_length() - 1) for i in range(1, 1 << 16)], np.int64)


class _Bits:
    """Bit readers at many places of one byte array."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(data) + 8
        words = np.zeros(n, np.uint64)
        for i in range(8):
            words |= padded[i : i + n] << np.uint64(56 - 8 * i)
        self.words = words

    def window(self, at: np.ndarray) -> np.ndarray:
        """64 bits from each place, the last 7 of which may be missing."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned values of ``width`` bits (up to 32, 0 gives 0)."""
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        return np.where(width > 0, (self.window(at) >> ((64 - width) & 63).astype(np.uint64)).astype(np.int64), 0)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        v = self.take(at, width)
        width = np.asarray(width, np.int64)
        return v - (((v >> np.maximum(width - 1, 0)) & 1) << width)

    def unary(self, at: np.ndarray) -> np.ndarray:
        top = self.window(at) >> np.uint64(48)
        zeros = _ZEROS[top]
        more = np.flatnonzero(zeros == 16)
        while len(more):
            step = _ZEROS[self.window(np.minimum(at[more] + zeros[more], (len(self.words) - 1) * 8)) >> np.uint64(48)]
            over = at[more] + zeros[more] >= (len(self.words) - 8) * 8
            zeros[more] += np.where(over, 0, step)
            more = more[(step == 16) & ~over]
        return zeros


def _residuals(bits: _Bits, at: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice residuals of subframes side by side (row i: of sample order + i), and the places behind them."""
    method = bits.take(at, 2)
    partitions = bits.take(at + 2, 4)
    at = at + 6
    count = size - order
    out = np.zeros((int(count.max(initial=0)), len(at)), np.int32)
    width = np.where(method == 0, 4, 5)
    part = size >> partitions
    k, raw = np.zeros(len(at), np.int64), np.full(len(at), -1)
    split = bool((partitions > 0).any())
    live = np.argsort(-count, kind="stable")
    at, count, order, width, part, k, raw = (v[live] for v in (at, count, order, width, part, k, raw))
    any_raw = False
    active = np.searchsorted(-count, -np.arange(len(out)), "left")
    for r in range(len(out)):
        m = int(active[r])
        if r == 0 or split:
            new = np.flatnonzero((r == 0) | ((order[:m] + r) % np.maximum(part[:m], 1) == 0))
            if r == 0:
                new = np.arange(m)
            if len(new):
                while len(new):
                    p = bits.take(at[new], width[new])
                    escape = p == (1 << width[new]) - 1
                    at[new] += width[new]
                    raw[new] = np.where(escape, bits.take(at[new], 5), -1)
                    at[new] += np.where(escape, 5, 0)
                    k[new] = np.where(escape, 0, p)
                    any_raw |= bool(escape.any())
                    # A partition that the warm-up fills whole has a parameter and no code.
                    new = new[(r == 0) & (order[new] >= part[new])] if r == 0 else new[:0]
                    if len(new):
                        raise ValueError("a first partition without samples")
        a, kk = at[:m], k[:m]
        window = bits.window(a)
        zeros = _ZEROS[window >> np.uint64(48)]
        if zeros.max(initial=0) == 16:
            zeros = bits.unary(a)
            window = bits.window(a + zeros)
            low = (window << np.uint64(1)) >> np.uint64(1)
            value = np.where(kk > 0, (low >> (63 - kk).astype(np.uint64)).astype(np.int64), 0)
        else:
            low = window << (zeros + 1).astype(np.uint64)
            value = np.where(kk > 0, (low >> ((64 - kk) & 63).astype(np.uint64)).astype(np.int64), 0)
        u = (zeros << kk) | value
        v = (u >> 1) ^ -(u & 1)
        step = zeros + 1 + kk
        if any_raw:
            is_raw = raw[:m] >= 0
            v = np.where(is_raw, bits.signed(a, np.maximum(raw[:m], 0)), v)
            step = np.where(is_raw, raw[:m], step)
        out[r, :m] = v
        at[:m] += step
    back = np.empty_like(live)
    back[live] = np.arange(len(live))
    return out[:, back], at[back]


def _subframes(bits: _Bits, at: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (samples x lanes) of one subframe of each lane, and the places behind them."""
    head = bits.take(at, 8)
    at = at + 8
    kind = head >> 1
    wasted = np.zeros(len(at), np.int64)
    waste = np.flatnonzero(head & 1)
    if len(waste):
        wasted[waste] = bits.unary(at[waste]) + 1
        at[waste] += wasted[waste]
    depth = depth - wasted
    out = np.zeros((int(size.max()), len(at)), np.int64)
    if (((kind > 1) & (kind < 8)) | ((kind > 12) & (kind < 32))).any():
        raise ValueError("reserved subframe type")
    lane = np.flatnonzero(kind == 0)
    if len(lane):
        out[:, lane] = bits.signed(at[lane], depth[lane])
        at[lane] += depth[lane]
    lane = np.flatnonzero(kind == 1)
    if len(lane):
        for i in range(int(size[lane].max())):
            on = lane[size[lane] > i]
            out[i, on] = bits.signed(at[on], depth[on])
            at[on] += depth[on]
    lane = np.flatnonzero(kind >= 8)
    if len(lane):
        linear = kind[lane] >= 32
        order = np.where(linear, (kind[lane] & 31) + 1, kind[lane] & 7)
        most = int(order.max(initial=0))
        coefficient, shift = np.zeros((most, len(lane)), np.int64), np.zeros(len(lane), np.int64)
        p, d = at[lane], depth[lane]
        for i in range(most):
            on = order > i
            out[i, lane[on]] = bits.signed(p[on], d[on])
            p[on] += d[on]
        for o in range(1, 5):
            on = ~linear & (order == o)
            if on.any():
                coefficient[:o, on] = np.array(FIXED[o])[:, None]
        on = np.flatnonzero(linear)
        if len(on):
            precision = bits.take(p[on], 4) + 1
            shift[on] = bits.signed(p[on] + 4, 5)
            p[on] += 9
            for i in range(most):
                more = order[on] > i
                coefficient[i, on[more]] = bits.signed(p[on[more]], precision[more])
                p[on[more]] += precision[more]
        rest, p = _residuals(bits, p, size[lane], order)
        at[lane] = p
        # The same loop for all orders: a lane's sample is its warm-up, or its residual plus the prediction.
        s = out[:, lane] if len(lane) < len(at) else out
        for o in np.unique(order).tolist():
            on = np.flatnonzero(order == o)
            whole = len(on) == len(order)
            t = s if whole else s[:, on]
            c, sh = coefficient[:o, on], shift[on]
            e = rest if whole else rest[:, on]
            n = int(size[lane][on].max())
            if o == 0:
                t[:n] = e[:n]
            else:
                for i in range(o, n):
                    guess = c[0] * t[i - 1]
                    for j in range(1, o):
                        guess += c[j] * t[i - 1 - j]
                    t[i] = e[i - o] + (guess >> sh)
            if not whole:
                s[:, on] = t
        out[:, lane] = s
    if len(waste):
        out <<= wasted
    return out, at


def decode_all(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """For each stream: samples (samples x channels), block offsets (one more at the end), CRC-16 flags of blocks, MD5 flag.

    Raises ValueError on a stream that is no FLAC or whose frame headers are damaged; a damaged body
    shows in the flags.
    """
    metas = [read_metadata(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    raw = data.tobytes()
    base = np.cumsum([0] + [len(s) for s in streams]).tolist()
    bits = _Bits(data)
    todo = [[base[i] + f for f in m.frames] if m.frames is not None else [base[i] + m.first] * (m.total > 0) for i, m in enumerate(metas)]
    blocks: list[list] = [[] for _ in streams]
    done = [0] * len(streams)
    while any(todo):
        # About SLICE samples are decoded side by side.
        waiting = [(i, f) for i, fs in enumerate(todo) for f in fs]
        most = max(1, SLICE // max(1, *(m.block for m in metas)))
        owner, frame = zip(*waiting[:most])
        heads = [read_header(raw, f, metas[i]) for i, f in zip(owner, frame)]
        starts = np.array(frame, np.int64)
        size, assignment, depth = (np.array([h[j] for h in heads], np.int64) for j in (1, 2, 3))
        at = (starts + np.array([h[0] for h in heads])) * 8
        channels = np.where(assignment < 8, assignment + 1, 2)
        got = []
        for c in range(int(channels.max())):
            on = np.flatnonzero(channels > c)
            side = ((assignment == 8) & (c == 1)) | ((assignment == 9) & (c == 0)) | ((assignment == 10) & (c == 1))
            samples, behind = _subframes(bits, at[on], size[on], (depth + side)[on])
            at[on] = behind
            full = np.zeros((int(size.max()), len(at)), np.int64)
            full[: len(samples), on] = samples
            got.append(full)
        if len(got) > 1:
            a, b = got[0].copy(), got[1].copy()
            for code, left, right in ((8, a, a - b), (9, a + b, b), (10, ((a << 1 | b & 1) + b) >> 1, ((a << 1 | b & 1) - b) >> 1)):
                on = assignment == code
                got[0][:, on], got[1][:, on] = left[:, on], right[:, on]
        stops = (at + 7) >> 3
        want = data[np.minimum(stops, len(data) - 2)].astype(np.int64) << 8 | data[np.minimum(stops + 1, len(data) - 1)]
        good = (stops + 2 <= len(data)) & (crc16_all(data, starts, np.minimum(stops, len(data))) == want)
        joined = np.stack([g.T for g in got], 2).astype(np.int32)
        following: list[list[int]] = [[] for _ in streams]
        for i, f in waiting[most:]:
            following[i].append(f)
        for n, (i, stop) in enumerate(zip(owner, stops.tolist())):
            blocks[i].append((joined[n, : size[n], : metas[i].channels], bool(good[n])))
            done[i] += int(size[n])
            if metas[i].frames is None and done[i] < metas[i].total and good[n]:
                following[i].append(stop + 2)
        todo = following
    out = []
    for m, parts in zip(metas, blocks):
        samples = np.concatenate([p for p, _ in parts]) if parts else np.zeros((0, m.channels), np.int32)
        width = -(-m.bits // 8)
        body = np.ascontiguousarray(samples.astype("<i4")).view(np.uint8).reshape(*samples.shape, 4)[:, :, :width].tobytes()
        offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in parts])]).astype(np.int64)
        out.append((samples, offsets, np.array([g for _, g in parts], bool), m.md5 == bytes(16) or hashlib.md5(body).digest() == m.md5))
    return out


def padded(text: np.ndarray) -> np.ndarray:
    """The payload of a text's bytes: bytes 0 appended up to a positive multiple of ``PAD``."""
    out = np.zeros(max(PAD, -(-len(text) // PAD) * PAD), np.uint8)
    out[: len(text)] = text
    return out


def _payloads(column: pa.Array):
    """Lists of (bytes of the text, payload) by slices of a string column."""
    for _, _, data, offsets in kernels.slices(column, SLICE):
        yield [(b - a, padded(data[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): every text, as UTF-8 padded with bytes 0, as the samples of a FLAC stream. A null text counts as empty."""
    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for part in _payloads(batch.column(1)):
                sizes += [n for n, _ in part]
                media += encode_all([p for _, p in part])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernels.tidy(run), f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _media_slices(media: list[bytes | None]):
    """Runs of streams of about ``SLICE`` bytes in all."""
    run, size = [], 0
    for m in media:
        if run and size + len(m) > SLICE:
            yield run
            run, size = [], 0
        run.append(m)
        size += len(m)
    if run:
        yield run


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, block, sample_offset, n_samples, pcm, crc_ok, md5_ok, error) of every block of every stream.

    ``pcm`` has little-endian signed samples, channels interleaved; a reader seeks by ``sample_offset``.
    A null or damaged stream gives one row with ``error`` and no block.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    samples, offsets, good, md5 = decode_all([m if m is not None else b""])[0]
                    width = -(-read_metadata(m).bits // 8)
                except (ValueError, IndexError, KeyError, TypeError) as e:
                    rows.append((i, None, None, None, None, None, None, str(e) or type(e).__name__))
                    continue
                for b, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    part = np.ascontiguousarray(samples[a:z].astype("<i4")).view(np.uint8).reshape(z - a, samples.shape[1], 4)
                    rows.append((i, b, a, z - a, part[:, :, :width].tobytes(), bool(good[b]), md5, None))
            columns = list(zip(*rows)) or [[]] * 8
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["id", "block", "sample_offset", "n_samples", "pcm", "crc_ok", "md5_ok", "error"])

    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(kernels.tidy(run), f"id {dict(rows.dtypes)['id']}, block int, sample_offset long, n_samples long, pcm binary, crc_ok boolean, md5_ok boolean, error string").withColumnRenamed("id", id_col)


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as FLAC, read back, verified and described.

    (id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): the
    payload's digests are of the decoded bytes; a failed check raises. ``feature`` has the blocks, the
    peak and the energy of the samples and the changes of sign. A null or empty text has 64 bytes 0. Equal texts have
    equal values; repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            out = []
            for part in _payloads(batch.column(1)):
                media = encode_all([p for _, p in part])
                for (n, _), m, (samples, offsets, good, md5) in zip(part, media, decode_all(media)):
                    if not (good.all() and md5):
                        raise ValueError("a stored stream does not verify")
                    s = samples[:, 0]
                    payload = (s + 128).astype(np.uint8).tobytes()
                    feature = f"blocks={len(good)};peak={int(np.abs(s).max())};energy={sum(int((s[i : i + SLICE].astype(np.int64) ** 2).sum()) for i in range(0, len(s), SLICE))};sign_changes={int(((s[1:] < 0) != (s[:-1] < 0)).sum())}"
                    out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernels.tidy(run), f"id {dict(rows.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
