"""Numpy kernels against plain Python."""

import random
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import flac, jaccard, kernel, lm, substring, toxicity, warc

TEXTS = ["", "a", "  a  b\tc\n", "ÄÖ é ÀB", "x " * 50, "one two three four five six", "\n\n", "a b c d e f g a b c d e"]


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", _lower(t))


def test_words_and_shingles():
    data, offs = kernel.texts(pa.array([*TEXTS, None]))
    s, e, row = kernel.words(data, offs)
    raw = bytes(data)
    for i, t in enumerate(TEXTS):
        assert [_lower(raw[a:b].decode()) for a, b, r in zip(s, e, row) if r == i] == _words(t)
    values, at = kernel.shingle_sets(data, offs)
    for i, t in enumerate([*TEXTS, ""]):
        w = _words(t)
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert at[i + 1] - at[i] == len(want)
    h = kernel.span_hashes(data, s, e)
    by = {}
    for k, (a, b) in enumerate(zip(s, e)):
        by.setdefault(_lower(raw[a:b].decode()), set()).add(int(h[k]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_partenum_signatures_lose_no_similar_pair():
    rng = np.random.default_rng(0)
    bands = jaccard.Bands()
    for n in [*range(1, 60), 90, 150, 400, 1000]:
        for _ in range(6):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            # the most differing set that still links
            b, k = a, 0
            while True:
                k += 1
                m = n - k // 2
                c = np.concatenate((a[: n - k // 2 - k % 2], rng.integers(0, 2**63, k // 2, dtype=np.uint64))) if k > 1 else a[: n - 1]
                inter = len(np.intersect1d(a, c))
                if not len(c) or 100 * inter < 80 * len(np.union1d(a, c)):
                    break
                b = c
            if len(b) == len(a) and (b == a).all():
                continue
            values, offs = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
            sig, row = jaccard.signatures(values, offs, bands)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (n, len(b), m)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 70, 300):
        a, b = np.unique(rng.integers(0, 400, n, dtype=np.uint64)), np.unique(rng.integers(0, 400, n, dtype=np.uint64))
        x, y = (np.frombuffer(s, np.uint64) for s in jaccard.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])))
        w = min(len(x), len(y))
        d = int(np.bitwise_count(jaccard.fold(x, w) ^ jaccard.fold(y, w)).sum())
        assert d <= len(np.setxor1d(a, b))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 40))
def test_suffix_order(text, depth):
    if not text:
        return
    data = np.frombuffer(text, np.uint8)
    got = np.concatenate(list(substring.suffix_order(data, np.arange(len(data)), depth, 7)))
    keys = [(text + bytes(depth))[i : i + depth] for i in got]
    assert sorted(got) == list(range(len(data))) and keys == sorted(keys)


def test_fragments_cover_every_window():
    rng = random.Random(3)
    text = "".join(rng.choice("abc ") for _ in range(5000)).encode()
    first, last, _, _ = substring.fragments(np.frombuffer(text, np.uint8))
    assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()
    assert len(substring.fragments(np.frombuffer(text[:49], np.uint8))[0]) == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=6))
def test_flac_round_trip(payloads):
    medias = flac.encode(payloads)
    assert [b"".join(b for _, b in blocks) for blocks in flac.decode(medias)] == payloads


class _Bits:
    """A plain reader of the format as its specification has it, bit by bit."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def u(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> (7 - self.at % 8) & 1
            self.at += 1
        return out

    def s(self, n):
        x = self.u(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self):
        n = 0
        while not self.u(1):
            n += 1
        return n


def _crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (width - 1) else 0)) & ((1 << width) - 1)
    return c


def _residual(r, order, size):
    bits, parts = (4, 5)[r.u(2)], r.u(4)
    out = []
    for k in range(1 << parts):
        n, m = (size >> parts) - (order if k == 0 else 0), r.u(bits)
        if m == (1 << bits) - 1:
            raw = r.u(5)
            out += [r.s(raw) for _ in range(n)]
        else:
            for _ in range(n):
                x = r.unary() << m | r.u(m)
                out.append(-(x + 1 >> 1) if x & 1 else x >> 1)
    return out


def _read_flac(data):
    r = _Bits(data)
    assert data[:4] == b"fLaC"
    r.at, last, info = 32, 0, None
    while not last:
        last, kind, n = r.u(1), r.u(7), r.u(24)
        if kind == 0:
            info = (r.u(16), r.u(16), r.u(24), r.u(24), r.u(20), r.u(3) + 1, r.u(5) + 1, r.u(36), r.u(128).to_bytes(16, "big"))
        else:
            r.at += 8 * n
    total, md5, samples = info[7], info[8], []
    assert info[5:7] == (1, 8)
    while len(samples) < total:
        begin = r.at >> 3
        assert r.u(14) == 0x3FFE and r.u(1) == 0
        r.u(1)
        size, rate = r.u(4), r.u(4)
        assert r.u(4) == 0 and r.u(3) in (0, 1) and r.u(1) == 0
        lead = r.u(8)
        while lead & 0x80 and (lead := lead << 1 & 0xFF) & 0x80:
            r.u(8)
        size = {1: 192, 6: None, 7: None}.get(size, 576 << (size - 2) if 2 <= size <= 5 else 256 << (size - 8) if size >= 8 else 0) or r.u(8 if size == 6 else 16) + 1
        r.u({12: 8, 13: 16, 14: 16}.get(rate, 0))
        assert _crc(data[begin : r.at >> 3], 0x07, 8) == r.u(8)
        assert r.u(1) == 0
        kind, width = r.u(6), 8
        if r.u(1):
            width -= r.unary() + 1
        if kind == 0:
            x = [r.s(width)] * size
        elif kind == 1:
            x = [r.s(width) for _ in range(size)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [r.s(width) for _ in range(order)]
            if kind < 32:
                coefficients, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order], 0
            else:
                precision, shift = r.u(4) + 1, r.s(5)
                coefficients = [r.s(precision) for _ in range(order)]
            for e in _residual(r, order, size):
                x.append(e + (sum(c * x[-1 - i] for i, c in enumerate(coefficients)) >> shift))
        samples += [v << (8 - width) for v in x]
        r.at = (r.at + 7) // 8 * 8
        assert _crc(data[begin : r.at >> 3], 0x8005, 16) == r.u(16)
    signed = bytes(v & 0xFF for v in samples)
    import hashlib

    assert md5 in (bytes(16), hashlib.md5(signed).digest())
    return bytes(v + 128 for v in samples)


def test_flac_by_a_plain_decoder():
    """The streams are what the format says, not only what the decoder beside the encoder reads."""
    rng = random.Random(6)
    payloads = [b"a text of the usual kind, with words and more words. " * 9, bytes(64), bytes(range(256)) * 3, bytes(rng.randrange(256) for _ in range(640)), b"x", "Größe 日本 ñandú ".encode() * 40, b"ab" * 3000]
    payloads = [flac.payload_of(p) for p in payloads]
    for p, media in zip(payloads, flac.encode(payloads)):
        assert _read_flac(media) == p
    x = [b - 128 for b in payloads[0]]
    rms = (sum(v * v for v in x) / len(x)) ** 0.5
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    assert flac.describe(np.frombuffer(payloads[0], np.uint8)) == f"mean={sum(x) / len(x):.4f};rms={rms:.4f};peak={max(map(abs, x))};crossings={crossings}"


def test_flac_blocks_checksums_and_streams_without_seek_table():
    payload = bytes(range(256)) * 17 + b"a" * 3000 + bytes(5)
    (media,) = flac.encode([payload])
    (blocks,) = flac.decode([media])
    assert [at for at, _ in blocks] == list(range(0, len(payload), flac.BLOCK))
    bad = bytearray(media)
    bad[-20] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode([media[:-7]])
    # without the seek table each frame starts where the last one ended
    size = int.from_bytes(media[43:46], "big")
    bare = media[:4] + bytes([0x80]) + media[5:42] + media[46 + size :]
    assert b"".join(b for _, b in flac.decode([bare])[0]) == payload
    assert flac.decode(flac.encode([b""])) == [[]]


def test_flac_fixed_predictors_by_hand():
    # one frame of order 1 without residual bits to spare: 0, 1, 2 ... rises by one
    ramp = bytes(range(100, 164))
    (media,) = flac.encode([ramp])
    assert b"".join(b for _, b in flac.decode([media])[0]) == ramp and len(media) < 42 + 22 + 60


def test_nnpu_prefers_toxic_words():
    rng = np.random.default_rng(5)
    words = rng.integers(100, 5000, (600, 30)).astype(np.int32)
    toxic = np.arange(600) % 6 == 0
    rows = [np.unique(np.append(w, [7, 8] if t else [9])) for w, t in zip(words, toxic)]
    model = toxicity.fit([r for r, t in zip(rows, toxic) if t], rows, toxic.mean(), dimensions=6000)
    s = model.score(*toxicity._csr(rows))
    assert s[toxic].min() > 0.5 > s[~toxic].max()
    empty = toxicity.fit([], rows, 0.1, 6000)
    assert abs(empty.score(*toxicity._csr([np.zeros(0, np.int32)]))[0] - 0.1) < 1e-6


def test_nnpu_risk_and_its_gradient():
    """The risk against its definition, the steps against differences of the risk and of the negated part."""
    rng = np.random.default_rng(4)
    soft = lambda z: math.log1p(math.exp(z))
    for shift in (-3.0, 0.0, 3.0):
        zp, zu, prior = rng.normal(1, 1, 5), rng.normal(shift, 1, 7), 0.4
        positive = prior * sum(soft(-z) for z in zp) / 5
        rest = sum(soft(z) for z in zu) / 7 - prior * sum(soft(z) for z in zp) / 5
        total, gp, gu = toxicity.risk(zp, zu, prior)
        assert total == pytest.approx(positive + max(rest, 0))
        goal = (lambda p, u: toxicity.risk(p, u, prior)[0]) if rest >= 0 else (lambda p, u: -(sum(map(soft, u)) / 7 - prior * sum(map(soft, p)) / 5))
        for z, g, side in ((zp, gp, 0), (zu, gu, 1)):
            for i in range(len(z)):
                e = np.zeros(len(z))
                e[i] = 1e-6
                a, b = ((z + e, zu), (z - e, zu)) if side == 0 else ((zp, z + e), (zp, z - e))
                assert g[i] == pytest.approx((goal(*a) - goal(*b)) / 2e-6, abs=1e-6)
    assert toxicity.risk(np.array([1.0]), np.array([-9.0]), 0.9)[0] == pytest.approx(0.9 * soft(-1.0))


def test_prior_from_positive_and_unlabelled_texts():
    rng = np.random.default_rng(5)
    text = lambda bad: np.unique(np.concatenate((rng.integers(0, 200, 30), rng.integers(200, 220, 6) if bad else rng.integers(220, 300, 6))))
    for prior in (0.05, 0.2, 0.5):
        unlabelled = [text(rng.random() < prior) for _ in range(3000)]
        assert toxicity.estimate_prior([text(True) for _ in range(400)], unlabelled, 300) == pytest.approx(prior, rel=0.2)


def test_warc_records_and_members():
    import io

    raw = [warc.record(1, "http://a/b c", b"<p>x</p>", None, None), warc.record(2, None, b"", 1, "http://a")]
    packed = b"".join(warc._member(r) for r in raw)
    back = list(warc.members(io.BytesIO(packed)))
    assert back == raw
    fields, block = warc.parse(back[0])
    assert fields["WARC-Type"] == "response" and block.endswith(b"<p>x</p>") and fields["WARC-Target-URI"] == "http://a/b%20c"
    assert warc.parse(back[1])[0]["WARC-Type"] == "revisit"
    with pytest.raises(OSError):
        list(warc.members(io.BytesIO(packed[:-5])))


def test_packed_arrays():
    for x in (np.zeros(0, np.uint64), np.arange(5, dtype=np.uint64) * 2**50, np.array([1.5, -2.0])):
        assert (lm.unpack(lm.pack(x), x.dtype.type) == x).all()
