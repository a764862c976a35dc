"""Media columns: FLAC streams in binary columns, encoded and decoded in numpy.

The decoder works on many frames at once, a lane each: Rice codes are read in
lockstep from 64-bit windows, then the linear predictors (fixed and LPC) are
run over the lanes together. Header CRC-8, frame CRC-16 and the stream's MD5
are verified. Streams carry a seek table with every frame, so that frames are
found without decoding what comes before; without one, each stream's next
frame starts where the last one ended. PCM comes out in blocks with the sample
offset of each.

Streams are mono with 8-bit samples (an unsigned byte b is the sample b - 128).
Defined results: a null payload is an empty one; a stream of no samples has no
frame; a wrong checksum, a cut-off stream or a feature outside of this subset
(wasted bits, several channels) raises ValueError with the reason. Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel as K

#: Samples of a frame, frames coded at once, order of the LPC predictor, bits of its coefficients.
BLOCK, LANES, ORDER, PRECISION = 1024, 2048, 4, 10
RATE = 8000
#: Fixed values of the format: coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _table(poly: int, bits: int) -> np.ndarray:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1) ^ poly if x >> (bits - 1) else x << 1
            x &= (1 << bits) - 1
        out.append(x)
    return np.array(out, np.uint32)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)
_ZEROS16 = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.uint8)


def crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = int(_CRC8[c ^ x])
    return c


def crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each range of bytes, all ranges in lockstep."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    c = np.zeros(len(at), np.uint32)
    for t in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -t, side="left"))
        x = c[:m]
        c[:m] = ((x << 8) & 0xFFFF) ^ _CRC16[(x >> 8) ^ buf[at[:m] + t]]
    out = np.empty_like(c)
    out[order] = c
    return out


@functools.lru_cache(1 << 14)
def frame_header(number: int, n: int) -> bytes:
    code = n.bit_length() - 1 if n in (256, 512, 1024, 2048, 4096, 8192, 16384, 32768) else 6 if n <= 256 else 7
    if number < 0x80:
        coded = bytes([number])
    else:
        tail, x = [], number
        size = 2
        while x >= 1 << (5 * size + 1):
            size += 1
        for _ in range(size - 1):
            tail.append(0x80 | (x & 0x3F))
            x >>= 6
        coded = bytes([(0xFF << (8 - size)) & 0xFF | x, *reversed(tail)])
    head = bytes([0xFF, 0xF8, code << 4, 0b0010]) + coded + (bytes([n - 1]) if code == 6 else (n - 1).to_bytes(2, "big") if code == 7 else b"")
    return head + bytes([crc8(head)])


@functools.lru_cache(1 << 14)
def _parsed(head: bytes) -> tuple[int, int]:
    """Samples and number of a frame with this header."""
    if head[0] != 0xFF or head[1] != 0xF8 or crc8(head[:-1]) != head[-1]:
        raise ValueError("a frame header is broken")
    if head[3] >> 4 or (head[3] >> 1) & 7 not in (0, 1) or head[2] & 15:
        raise ValueError("only mono streams of 8-bit samples with the stream's rate")
    lead = head[4]
    size = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    number = lead if size == 1 else lead & ((1 << (7 - size)) - 1)
    for x in head[5 : 4 + size]:
        number = number << 6 | x & 0x3F
    code = head[2] >> 4
    n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else int.from_bytes(head[4 + size : -1], "big") + 1 if code in (6, 7) else 1 << code
    return n, number


def _header_at(buf: np.ndarray, at: int) -> bytes:
    head = buf[at : at + 20].tobytes()
    if len(head) < 6:
        raise ValueError("a frame is cut off")
    size = 1 if head[4] < 0x80 else 8 - (head[4] ^ 0xFF).bit_length()
    return head[: 5 + size + (1 if head[2] >> 4 == 6 else 2 if head[2] >> 4 == 7 else 0)]


def _put(buf: np.ndarray, at: np.ndarray, bits: np.ndarray | int, value: np.ndarray) -> None:
    """Write values of up to 16 bits at bit positions of a zeroed buffer."""
    word = value.astype(np.uint32) << (24 - (at & 7) - bits).astype(np.uint32)
    at = at >> 3
    np.add.at(buf, at, (word >> 16).astype(np.uint8))
    np.add.at(buf, at + 1, (word >> 8).astype(np.uint8))
    np.add.at(buf, at + 2, word.astype(np.uint8))


def _lpc(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of order ORDER for each lane, and the shift."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, d:], f[:, : f.shape[1] - d]) for d in range(ORDER + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-3
    a, e = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - sum((a[:, j] * r[:, i - j] for j in range(i)), np.zeros(len(x)))) / e
        old = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = old - k[:, None] * old[:, ::-1]
        e *= np.maximum(1 - k * k, 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int32), shift.astype(np.int32)


def encode_frames(x: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the rows of x (int32 samples, n valid ones each): bytes and offsets."""
    lanes, width = x.shape
    col = np.arange(width, dtype=np.int32)
    valid = col < n[:, None]
    coef, shift = _lpc(x, n)
    residuals = [x]
    for _ in range(2):
        d = np.zeros_like(x)
        d[:, 1:] = residuals[-1][:, 1:] - residuals[-1][:, :-1]
        residuals.append(d)
    total = np.zeros_like(x)
    for j in range(ORDER):
        total[:, ORDER:] += coef[:, j : j + 1] * x[:, ORDER - 1 - j : width - 1 - j]
    residuals.append(x - (total >> shift[:, None]))
    orders = np.array([0, 1, 2, ORDER])
    cost = np.stack([np.where(valid[:, p:], np.abs(r[:, p:]), 0).sum(1) for p, r in zip(orders, residuals, strict=True)], 1)
    cost[:, 3] += (ORDER * PRECISION + 9) * 8
    cost[n <= ORDER] = [0, 1, 1, 1]
    best = cost.argmin(1)
    r = np.choose(best[:, None], residuals)
    p = orders[best]
    u = ((r << 1) ^ (r >> 31)).astype(np.int64)
    coded = valid & (col >= p[:, None])
    u[~coded] = 0
    parts = np.where((n % 4 == 0) & (n // 4 > ORDER), 4, 1)
    size = n // parts
    run = np.zeros((lanes, width + 1), np.int64)
    np.cumsum(u, axis=1, out=run[:, 1:])
    edge = np.minimum(np.arange(5)[None, :] * size[:, None], n[:, None])
    rows = np.arange(lanes)[:, None]
    sums = run[rows, edge[:, 1:]] - run[rows, edge[:, :-1]]
    counts = np.maximum(np.diff(edge, axis=1) - np.where(np.arange(4) == 0, p[:, None], 0), 1)
    k = np.clip(np.rint(np.log2(np.maximum(sums / counts * 0.6931, 1e-9))), 0, 14).astype(np.int64)
    part = np.minimum(col // np.maximum(size, 1)[:, None], parts[:, None] - 1)
    kk = np.take_along_axis(k, part, 1)
    length = np.where(coded, (u >> kk) + 1 + kk, 0)
    opens = np.zeros((lanes, width), bool)
    for t in range(4):
        has = parts > t
        at = np.where(t == 0, p, t * size)[has]
        inside = at < width
        opens[np.flatnonzero(has)[inside], at[inside]] = True
    bits = length + 4 * (opens & valid)
    ends = np.cumsum(bits, axis=1)
    heads = [frame_header(int(a), int(b)) for a, b in zip(numbers, n, strict=True)]
    hlen = np.array([len(h) for h in heads])
    lpc = best == 3
    fields = 8 + 8 * p + np.where(lpc, 9 + ORDER * PRECISION, 0) + 6
    body = fields + ends[:, -1]
    constant = (np.where(valid, x, x[:, :1]) == x[:, :1]).all(1)
    verbatim = ~constant & (body >= 8 + 8 * n)
    rice = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, body))
    nbytes = hlen + (body + 7) // 8 + 2
    offs = np.concatenate(([0], np.cumsum(nbytes)))
    buf = np.zeros(int(offs[-1]) + 4, np.uint8)
    start = offs[:-1]
    joined = np.frombuffer(b"".join(heads), np.uint8)
    buf[K.ranges(start, hlen)] = joined
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 0x20 | (ORDER - 1), 8 | p)))
    buf[start + hlen] = (kind << 1).astype(np.uint8)
    sample = (x & 0xFF).astype(np.uint8)
    i = np.flatnonzero(constant)
    buf[start[i] + hlen[i] + 1] = sample[i, 0]
    i = np.flatnonzero(verbatim)
    buf[K.ranges(start[i] + hlen[i] + 1, n[i])] = sample[i][valid[i]]
    i = np.flatnonzero(rice)
    for t in range(ORDER):
        j = i[p[i] > t]
        buf[start[j] + hlen[j] + 1 + t] = sample[j, t]
    at = (start + hlen + 1 + p) * 8
    j = i[lpc[i]]
    _put(buf, at[j], 4, np.full(len(j), PRECISION - 1))
    _put(buf, at[j] + 4, 5, shift[j])
    for t in range(ORDER):
        _put(buf, at[j] + 9 + t * PRECISION, PRECISION, coef[j, t] & ((1 << PRECISION) - 1))
    at = at + np.where(lpc, 9 + ORDER * PRECISION, 0)
    _put(buf, at[i], 6, np.where(parts[i] == 4, 2, 0))
    at = at + 6
    take = coded & rice[:, None]
    end = (at[:, None] + ends)[take]
    kt, ut = kk[take], u[take]
    _put(buf, end - kt - 1, kt + 1, (1 << kt) | (ut & ((1 << kt) - 1)))
    take = opens & valid & rice[:, None]
    lane, c = np.nonzero(take)
    _put(buf, at[lane] + ends[lane, c] - bits[lane, c], 4, kk[lane, c])
    crc = crc16(buf, start, offs[1:] - 2)
    buf[offs[1:] - 2], buf[offs[1:] - 1] = (crc >> 8).astype(np.uint8), (crc & 0xFF).astype(np.uint8)
    return buf[: offs[-1]], offs


def _stream_head(payload: bytes, sizes: np.ndarray, counts: np.ndarray) -> bytes:
    n = len(payload)
    info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min(initial=0)).to_bytes(3, "big") + int(sizes.max(initial=0)).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big")
    # the digest is of the signed samples
    info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
    points = np.zeros(len(sizes), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"] = np.cumsum(counts) - counts
    points["offset"] = np.cumsum(sizes) - sizes
    points["n"] = counts
    seek = points.tobytes()
    return b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload."""
    frames = [(i, f, a, min(BLOCK, len(x) - a)) for i, x in enumerate(payloads) for f, a in enumerate(range(0, len(x), BLOCK))]
    pieces: list[list[bytes]] = [[] for _ in payloads]
    for lo in range(0, len(frames), LANES):
        some = frames[lo : lo + LANES]
        n = np.array([f[3] for f in some])
        x = np.zeros((len(some), max(int(n.max()), ORDER + 1)), np.uint8)
        for row, (i, _, a, m) in zip(x, some, strict=True):
            row[:m] = np.frombuffer(payloads[i], np.uint8, m, a)
        samples = np.where(np.arange(x.shape[1]) < n[:, None], x.astype(np.int32) - 128, 0)
        buf, offs = encode_frames(samples, n, np.array([f[1] for f in some]))
        raw = buf.tobytes()
        for (i, *_), a, b in zip(some, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            pieces[i].append(raw[a:b])
    out = []
    for payload, parts in zip(payloads, pieces, strict=True):
        counts = np.full(len(parts), BLOCK)
        if len(parts):
            counts[-1] = len(payload) - BLOCK * (len(parts) - 1)
        out.append(_stream_head(payload, np.array([len(x) for x in parts], np.int64), counts) + b"".join(parts))
    return out


class _Bits:
    """64-bit windows at bit positions."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate((buf, np.zeros(16, np.uint8)))
        self.words = np.zeros(len(buf) + 8, np.uint64)
        for t in range(8):
            self.words = (self.words << np.uint64(8)) | padded[t : t + len(self.words)]

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
        """Up to 57 bits."""
        return ((self.peek(at) >> np.uint64(1)) >> np.asarray(63 - bits).astype(np.uint64)).astype(np.int64)


def _signed(x: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    top = np.left_shift(1, np.asarray(bits) - 1)
    return (x ^ top) - top


def decode_frames(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples (a row per frame), their numbers, the frames' numbers, and where each frame ends."""
    heads = [_header_at(buf, int(s)) for s in starts]
    n, numbers = (np.array(v) for v in zip(*map(_parsed, heads), strict=True))
    order_by = np.argsort(-n, kind="stable")  # lanes that end early are at the end
    n, starts = n[order_by], starts[order_by]
    at = (starts + np.array([len(h) for h in heads])[order_by]) * 8
    bits = _Bits(buf)
    kind = bits.read(at, 8)
    if (kind & 0x81).any():
        raise ValueError("wasted bits aren't supported, and the first bit must be 0")
    kind >>= 1
    at += 8
    lanes, width = len(n), int(n[0])
    x = np.zeros((width, lanes), np.int32)
    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    x[:, constant] = _signed(bits.read(at[constant], 8), 8)
    at[constant] += 8
    for lane in verbatim:
        a = int(at[lane] >> 3)
        if a + n[lane] > len(buf):
            raise ValueError("a frame is cut off")
        x[: n[lane], lane] = (buf[a : a + n[lane]] ^ 0x80).astype(np.int32) - 128
    at[verbatim] += 8 * n[verbatim]
    fixed, lpc = (kind & 0x38) == 8, kind >= 32
    if (~(fixed | lpc | (kind < 2))).any() or (fixed & (kind & 7 > 4)).any():
        raise ValueError("a subframe's type is reserved")
    live = np.flatnonzero(fixed | lpc)
    order = np.where(fixed, kind & 7, np.where(lpc, (kind & 31) + 1, 0))
    most = int(order[live].max(initial=0))
    for t in range(most):
        j = live[order[live] > t]
        x[t, j] = _signed(bits.read(at[j], 8), 8)
        at[j] += 8
    coef, shift = np.zeros((max(most, 1), lanes), np.int64), np.zeros(lanes, np.int64)
    for p in range(1, 5):
        j = np.flatnonzero(fixed & (order == p))
        if len(j):
            coef[:p, j] = np.array(FIXED[p])[:, None]
    j = np.flatnonzero(lpc)
    precision = bits.read(at[j], 4) + 1
    shift[j] = _signed(bits.read(at[j] + 4, 5), 5)
    if (precision == 16).any() or (shift < 0).any():
        raise ValueError("a predictor's precision or shift is invalid")
    at[j] += 9
    for t in range(most):
        some = order[j] > t
        coef[t, j[some]] = _signed(bits.read(at[j[some]], precision[some]), precision[some])
        at[j[some]] += precision[some]

    # Rice codes in lockstep; lanes are in order of falling size
    method, parts = bits.read(at[live], 2), bits.read(at[live] + 2, 4)
    if (method > 1).any():
        raise ValueError("a residual's coding method is reserved")
    wide = 4 + method
    at[live] += 6
    a, size, todo = at[live], n[live] >> parts, n[live]
    left = size - order[live]
    if (left < 0).any():
        raise ValueError("a partition is smaller than its predictor's order")
    k, raw = np.zeros(len(live), np.int64), np.zeros(len(live), bool)
    fresh = np.ones(len(live), bool)
    res = np.zeros((width, len(live)), np.int32)
    first = order[live]
    one = np.uint64(1)
    for t in range(int(todo.max(initial=0))):
        m = int(np.searchsorted(-todo, -t, side="left"))
        new = np.flatnonzero(fresh[:m] & (first[:m] <= t))
        while len(new):  # an empty first partition is followed by the next one's parameter
            k[new] = bits.read(a[new], wide[new])
            a[new] += wide[new]
            raw[new] = k[new] == (1 << wide[new]) - 1
            esc = new[raw[new]]
            k[esc] = bits.read(a[esc], 5)
            a[esc] += 5
            fresh[new] = False
            new = new[left[new] == 0]
            left[new] = size[new]
        pos, kk = a[:m], k[:m].astype(np.uint64)
        w = bits.peek(pos)
        q = _ZEROS16[(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        if (q == 16).any():
            for i in np.flatnonzero(q == 16):
                if first[i] <= t and not raw[i]:
                    c, b = 0, int(pos[i])
                    while (z := int(_ZEROS16[int(bits.peek(np.array([b]))[0]) >> 48])) == 16:
                        c, b = c + 16, b + 16
                        if b >> 3 > len(buf):
                            raise ValueError("a frame is cut off")
                    q[i] = c + z
                    w[i] = bits.peek(np.array([b]))[0] << np.uint64(z)
                    w[i] = w[i] >> np.uint64(min(z, 0))
            long = q >= 16
            skip = np.where(long, 1, q + 1).astype(np.uint64)
        else:
            skip = q.astype(np.uint64) + one
        r = (((w << skip) >> one) >> (np.uint64(63) - kk)).astype(np.int64)
        v = (q << k[:m]) | r
        value = (v >> 1) ^ -(v & 1)
        step = q + 1 + k[:m]
        if raw[:m].any():
            i = np.flatnonzero(raw[:m])
            some = i[k[i] > 0]
            value[i] = 0
            value[some] = _signed(bits.read(pos[some], k[some]), k[some])
            step[i] = k[i]
        if t < most:
            on = first[:m] <= t
            value, step = np.where(on, value, 0), np.where(on, step, 0)
            left[:m] -= on
        else:
            left[:m] -= 1
        res[t, :m] = value
        a[:m] += step
        done = np.flatnonzero((left[:m] == 0) & (first[:m] <= t))
        fresh[done] = True
        left[done] = size[done]
    at[live] = a
    # predictors, all lanes with one together
    j = live[order[live] == 0]
    x[:, j] = res[:, order[live] == 0]
    some = np.flatnonzero(order[live] > 0)
    if len(some):
        j = live[some]
        y, c, s, p, rr = x[:, j].astype(np.int64), coef[:, j], shift[j], order[j], res[:, some]
        for t in range(1, width):
            total = np.zeros(len(j), np.int64)
            for d in range(min(t, most)):
                total += c[d] * y[t - 1 - d]
            y[t] = np.where(t >= p, rr[t] + (total >> s), y[t])
        x[:, j] = y
    end = (at + 7) // 8 + 2
    if (end > len(buf)).any():
        raise ValueError("a frame is cut off")
    stored = (buf[end - 2].astype(np.uint32) << 8) | buf[end - 1]
    if (crc16(buf, starts, end - 2) != stored).any():
        raise ValueError("a frame's checksum differs")
    back = np.empty_like(order_by)
    back[order_by] = np.arange(lanes)
    return x.T[back], n[back], numbers, end[back]


class Stream:
    """Metadata of a stream: samples, digest, place of the frames."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, None
        while not last:
            if at + 4 > len(media):
                raise ValueError("the metadata is cut off")
            last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
            data = media[at + 4 : at + 4 + size]
            if kind == 0:
                v = int.from_bytes(data[10:18], "big")
                if (v >> 41) & 7 or (v >> 36) & 31 != 7:
                    raise ValueError("only mono streams of 8-bit samples")
                self.total, self.md5 = v & ((1 << 36) - 1), data[18:34]
            elif kind == 3:
                points = np.frombuffer(data, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
                self.points = points[points["sample"] != 2**64 - 1]
            at += 4 + size
        self.first = at


def decode(medias: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of each stream: (sample offset, unsigned bytes), checksums verified."""
    streams = [Stream(m) for m in medias]
    out: list[list[tuple[int, bytes]]] = [[] for _ in medias]
    base = np.concatenate(([0], np.cumsum([len(m) for m in medias])))
    buf = np.frombuffer(b"".join(medias), np.uint8)
    jobs, todo = [], []
    for i, s in enumerate(streams):
        whole = s.points is not None and int(s.points["n"].astype(np.int64).sum()) == s.total
        if whole:
            jobs += [(i, int(base[i]) + s.first + int(o)) for o in s.points["offset"]]
        elif s.total:
            todo.append((i, int(base[i]) + s.first))

    def run(some: list[tuple[int, int]]) -> list[tuple[int, int]]:
        # only the bytes of these streams are looked at
        lo, hi = int(base[some[0][0]]), int(base[some[-1][0] + 1])
        x, n, _, end = decode_frames(buf[lo:hi], np.array([a - lo for _, a in some]))
        pcm = (x + 128).astype(np.uint8)
        following = []
        for row, m, (i, _), e in zip(pcm, n.tolist(), some, end.tolist(), strict=True):
            at = out[i][-1][0] + len(out[i][-1][1]) if out[i] else 0
            out[i].append((at, row[:m].tobytes()))
            if at + m < streams[i].total:
                following.append((i, lo + e))
        return following

    for a in range(0, len(jobs), LANES):
        run(jobs[a : a + LANES])
    while todo:
        todo = [x for a in range(0, len(todo), LANES) for x in run(todo[a : a + LANES])]
    for s, blocks in zip(streams, out, strict=True):
        pcm = np.frombuffer(b"".join(b for _, b in blocks), np.uint8)
        if len(pcm) != s.total or (any(s.md5) and hashlib.md5((pcm ^ 0x80).tobytes()).digest() != s.md5):
            raise ValueError("the stream's samples differ from its digest")
    return out


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with zeros to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def encode_column(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): the text's padded UTF-8 bytes as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, text):
            data, offs = K.texts(part.column(text))
            raw = data.tobytes()
            media = encode([payload_of(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(np.diff(offs)), pa.array(media, pa.binary())], [id_column, "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"{id_column} {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, sample_offset, pcm) of each block of the streams in column ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "media"):
            ids = part.column(id_column)
            rows = [(i, at, pcm) for i, blocks in enumerate(decode([x or b"" for x in part.column("media").to_pylist()])) for at, pcm in blocks]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], [id_column, "sample_offset", "pcm"])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(id_column, "media").mapInArrow(run, f"{id_column} {kind}, sample_offset long, pcm binary")


def describe(pcm: np.ndarray) -> str:
    """Features of the samples: level, root mean square, peak, zero crossings."""
    x = pcm.astype(np.int16) - 128
    return f"mean={x.mean():.4f};rms={np.sqrt(np.mean(np.square(x, dtype=np.float64))):.4f};peak={int(np.abs(x).max())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


_FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What the streams in column ``media`` hold, read back block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "media"):
            medias = part.column("media").to_pylist()
            rows = []
            for m, blocks in zip(medias, decode(medias), strict=True):
                pcm = b"".join(b for _, b in blocks)
                rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-64:]), len(m), hashlib.sha256(m).hexdigest(), describe(np.frombuffer(pcm, np.uint8))))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(id_column), part.column("n_bytes"), *cols], [id_column, "n_bytes", *(f.split()[0] for f in _FEATURES.split(", ")[1:])])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(id_column, "n_bytes", F.col("media")).mapInArrow(run, f"{id_column} {kind}, {_FEATURES}")
