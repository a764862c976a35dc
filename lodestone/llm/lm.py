"""Language-model scoring with a Katz backoff model of any order.

Texts are packed into slices of some MB: a dictionary of word hashes and the
tokens as indices. Order by order, a slice asks for the counts of its distinct
n-grams; requests go to buckets of the hash space, which hold the n-gram tables
as sorted, packed keys and counts, and are answered per slice. So a very common
n-gram costs one request per slice, not one per document. Count-of-counts of the
whole training part give the Good-Turing discounts of each order; the seen mass
of each history is summed over its distinct n-grams (each is owned by one slice),
which gives backoff weights that normalise exactly. Probabilities are evaluated
recursively, for the distinct n-grams of a slice:

    P(w | h) = d(c) c(h, w) / c'(h)        if the n-gram was seen
             = alpha(h) P(w | h')          otherwise; h' is h without its first word;
                                           alpha = 1 for an unseen h
    P(w)     = d(c) c(w) / N'              if the word was seen, else P(unk)

d(c) discounts counts up to 5; c' and N' add 1 where nothing was discounted,
so that unseen events always have mass; P(unk) is what the seen words leave.
A text's history starts with begin marks that are no tokens; its last token is
an end mark.

Defined results: a null or empty text is its end token alone; repeated rows
count and are scored each; a null id is never held out; with no training text
every probability of an unknown word is 1 (score 0). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel as K
from lodestone.runtime import materialize

U64 = np.uint64
#: Words of the longest n-grams by default. Distinct n-grams of three words are nearly as many as tokens: counting
#: them moved 8.6 times the (compressed) input and needed over 7 times of it on disk.
ORDER = 2
#: Text bytes of a slice; keys that a bucket holds on average; counts that are discounted.
SLICE, BUCKET, MOST = 8 << 20, 1_500_000, 5
#: Hashes of the marks that end and begin a text.
END, BEGIN = U64(0x0E4D), U64(0xBE61)
_FLAT = U64((1 << 48) - 1)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: sorted keys and small counts take little."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    raw = np.ascontiguousarray(planes).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n, "zstd", asbytes=True), np.uint8).reshape(size, n // size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their distances."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


_SLICE = "slice long, ids binary, valid binary, held binary, sizes binary, words binary, tokens binary, n_words long, n_tokens long"
_SLICE_ARROW = pa.schema([("slice", pa.int64()), *((c, pa.binary()) for c in ("ids", "valid", "held", "sizes", "words", "tokens")), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


class Level:
    """Distinct n-grams of a slice: sorted keys; of each its history and its last words (indices of the
    level below); of each token its n-gram; and the n-gram of begin marks only, which is a history but no event."""

    def __init__(self, keys: np.ndarray, history: np.ndarray, suffix: np.ndarray, of: np.ndarray, begin: int):
        self.keys, self.history, self.suffix, self.of, self.begin = keys, history, suffix, of, begin


class Slice:
    """Documents of a slice: ids, held-out flags, sizes in tokens, words (sorted hashes), tokens (indices)."""

    def __init__(self, row: dict):
        self.ids, self.valid, self.held = unpack(row["ids"], np.int64), unpack(row["valid"], np.uint8) > 0, unpack(row["held"], np.uint8) > 0
        self.sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        self.words, self.tokens = unpack_keys(row["words"]), unpack(row["tokens"], np.uint32).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.train = np.repeat(~self.held, self.sizes)

    def levels(self, order: int) -> list[Level]:
        """Levels 1 to ``order``, at their number."""
        none = np.zeros(0, np.int64)
        out = [Level(np.zeros(0, np.uint64), none, none, none, 0), Level(self.words, none, none, self.tokens, int(np.searchsorted(self.words, BEGIN)))]
        begin = out[1].begin
        for _ in range(1, order):
            below = out[-1]
            history = np.empty_like(self.tokens)
            history[1:] = below.of[:-1]
            history[self.first] = below.begin
            code, inverse = np.unique(np.append(history * len(self.words) + self.tokens, below.begin * len(self.words) + begin), return_inverse=True)
            h, w = code // len(self.words), code % len(self.words)
            keys = K.mix(below.keys[h] * U64(0xD6E8FEB86659FD93) + K.seeded(self.words[w], 23))
            by = np.argsort(keys)
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            of = place[inverse[:-1]]
            suffix = np.full(len(by), below.begin)
            suffix[of] = below.of
            out.append(Level(keys[by], h[by], suffix, of, int(place[inverse[-1]])))
        return out

    def counts(self, level: Level) -> np.ndarray:
        """Training count of each n-gram; of the begin marks, the training texts."""
        c = np.bincount(level.of[self.train], minlength=len(level.keys))
        c[level.begin] = int((~self.held).sum())
        return c


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId() << 32, 0
    hashes, sizes, ids, valid, held, held_bytes = [], [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal number
        every = np.concatenate(hashes)
        words, tokens = np.unique(np.append(every, BEGIN), return_inverse=True)
        row = {
            "slice": task + number,
            "ids": pack(np.concatenate(ids)),
            "valid": pack(np.concatenate(valid)),
            "held": pack(np.concatenate(held)),
            "sizes": pack(np.concatenate(sizes).astype(np.uint32)),
            "words": pack_keys(words),
            "tokens": pack(tokens[:-1].astype(np.uint32)),
            "n_words": len(words),
            "n_tokens": len(every),
        }
        number += 1
        return pa.RecordBatch.from_pylist([row], schema=_SLICE_ARROW)

    for part in K.slices(batches, "text"):
        data, offs = K.texts(part.column("text"))
        starts, ends, row = K.words(data, offs)
        n = np.bincount(row, minlength=part.num_rows)
        out = np.full(len(starts) + part.num_rows, END)
        out[np.arange(len(starts)) + row] = K.span_hashes(data, starts, ends)
        hashes.append(out)
        sizes.append(n + 1)
        column = part.column("doc_id")
        valid.append(np.array(column.is_valid()).astype(np.uint8))
        ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        held.append(np.array(part.column("held_out").to_pylist(), np.uint8))
        held_bytes += int(offs[-1]) + 16 * part.num_rows
        if held_bytes >= SLICE:
            yield flush()
            hashes, sizes, ids, valid, held, held_bytes = [], [], [], [], [], 0
    if hashes:
        yield flush()


_ASK = "bucket int, slice long, keys binary, counts binary, begin long"
_ASK_ARROW = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("begin", pa.int64())])


def _cuts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    of = bucket_of(keys, buckets)
    cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(of)], strict=False):
        yield int(of[a]), a, b


def _ask(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice(batch.slice(i, 1).to_pylist()[0])
                level = s.levels(order)[order]
                counts = s.counts(level).astype(np.uint32)
                begin = level.keys[level.begin]
                rows = [
                    {"bucket": k, "slice": batch.column("slice")[i].as_py(), "keys": pack_keys(level.keys[a:b]), "counts": pack(counts[a:b]), "begin": int(begin.view(np.int64))}
                    for k, a, b in _cuts(level.keys, buckets)
                ]
                del s, level, counts
                yield pa.RecordBatch.from_pylist(rows, schema=_ASK_ARROW)
                K.tidy()

    return run


#: Kinds of replies: an order's counts; beyond this number, an order's backoff weights. Negative: a bucket's table and statistics.
WEIGHTS = 100
_REPLY = "kind int, slice long, bucket int, data binary, more binary, stats array<double>"
_REPLY_ARROW = pa.schema([("kind", pa.int32()), ("slice", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("stats", pa.list_(pa.float64()))])


def _answer(order: int):
    """Counts of one bucket: its table, its part of the count-of-counts, and a reply to each slice."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        bucket = table.column("bucket")[0].as_py()
        keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        begin = np.int64(table.column("begin")[0].as_py()).view(np.uint64)
        counts = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        size = np.array([len(k) for k in keys])
        every = np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        sorted_ = every[by]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[by], first)
        of = np.cumsum(new) - 1
        # the first slice with a training occurrence owns the entry
        seen = counts[by] > 0
        rank = np.cumsum(seen)
        before = np.concatenate(([0], rank))[first]
        owner = seen & (rank - before[of] == 1)
        value = np.empty(len(every), np.int64)
        value[by] = total[of] * 2 + owner
        unique = sorted_[first]
        known = total > 0
        counted = total[known & (unique != begin)]
        stats = [float(counted.sum()), float(len(counted)), *(float(x) for x in np.bincount(np.minimum(counted, MOST + 2), minlength=MOST + 3)[1 : MOST + 2])]
        rows = [{"kind": -order, "slice": None, "bucket": bucket, "data": pack_keys(unique[known]), "more": pack(total[known].astype(np.uint64)), "stats": stats}]
        end = np.cumsum(size)
        rows += [{"kind": order, "slice": s, "bucket": bucket, "data": pack(value[e - n : e].astype(np.uint64))} for s, n, e in zip(table.column("slice").to_pylist(), size, end, strict=True)]
        return pa.Table.from_pylist(rows, schema=_REPLY_ARROW)

    return run


class Discounts:
    """Good-Turing discounts from the count-of-counts of one order."""

    def __init__(self, stats: list[float] | None):
        stats = stats or [0.0] * (MOST + 3)
        self.total, self.types, n = stats[0], stats[1], [0.0, *stats[2:]]
        self.n = n
        d = np.ones(MOST + 2)
        common = (MOST + 1) * n[MOST + 1] / n[1] if n[1] else 1.0
        for r in range(1, MOST + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
            # where the count-of-counts give no discount, the absolute one of n1 / (n1 + 2 n2)
            d[r] = x if 0 < x < 1 else (r - (n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5)) / r
        self.d = d

    def mass(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.d[np.minimum(c, MOST + 1)] * c


class Unigrams(Discounts):
    def __init__(self, stats: list[float] | None):
        super().__init__(stats)
        low = sum(self.n[r] * r for r in range(1, MOST + 1))
        self.denominator = self.total + (low == 0)
        seen = sum(self.n[r] * r * self.d[r] for r in range(1, MOST + 1)) + self.total - low
        self.unknown = 1 - seen / self.denominator if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.mass(c) / self.denominator, self.unknown)


def _replies(table: pa.Table) -> dict[int, np.ndarray | tuple]:
    """The replies to one slice, joined in the order of its keys."""
    found: dict[int, list] = {}
    for kind, bucket, data, more in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "data", "more")), strict=True):
        found.setdefault(kind, []).append((bucket, data, more))
    out: dict = {}
    for kind, rows in found.items():
        rows.sort(key=lambda r: r[0])
        if kind > WEIGHTS:
            out[kind] = tuple(np.concatenate([unpack(r[k], t) for r in rows]) for k, t in ((1, np.float64), (2, np.uint8)))
        else:
            out[kind] = np.concatenate([unpack(r[1], np.uint64) for r in rows]).astype(np.int64)
    return out


class Grams:
    """A slice's n-grams with their counts over all, and the probabilities of the orders that are weighed."""

    def __init__(self, row: dict, replies: dict, stats: list[list[float] | None], order: int):
        self.slice = Slice(row)
        self.level, self.unigrams = self.slice.levels(order), Unigrams(stats[1])
        self.discounts = [None, None, *(Discounts(x) for x in stats[2:])]
        self.count = [None, *(replies[k] >> 1 for k in range(1, order + 1))]
        self.own = [None, *(replies[k] & 1 == 1 for k in range(1, order + 1))]
        self.extra: dict[int, np.ndarray] = {}
        self.alpha: dict[int, np.ndarray] = {}
        for k in range(2, order + 1):
            if WEIGHTS + k in replies:
                alpha, extra = replies[WEIGHTS + k]
                said, needed = self.said(k)
                self.extra[k], self.alpha[k] = np.zeros(len(said)), np.ones(len(said))
                self.extra[k][said], self.alpha[k][needed] = extra, alpha

    def events(self, k: int, which: np.ndarray) -> np.ndarray:
        which = which.copy()
        which[self.level[k].begin] = False
        return np.flatnonzero(which)

    def said(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the level below, which histories this slice sends sums of, and of which it needs the backoff
        weight. Of the others it knows that something is discounted, as all that follows is rare."""
        n, history = len(self.level[k - 1].keys), self.level[k].history
        needed = np.bincount(history[self.events(k, self.count[k] == 0)], minlength=n) > 0
        return needed | (np.bincount(history[self.events(k, self.own[k])], minlength=n) > 0) | (self.count[k - 1] > MOST), needed

    def seen(self, k: int, at: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams of an order that were seen."""
        if k == 1:
            return self.unigrams.p(self.count[1][at])
        history = self.level[k].history[at]
        return self.discounts[k].mass(self.count[k][at]) / np.maximum(self.count[k - 1][history] + self.extra[k][history], 1)

    def probability(self, k: int) -> np.ndarray:
        """Of all n-grams of an order, backing off recursively."""
        out = self.seen(k, np.arange(len(self.count[k])))
        if k > 1:
            off = np.flatnonzero(self.count[k] == 0)
            out[off] = self.alpha[k][self.level[k].history[off]] * self.probability(k - 1)[self.level[k].suffix[off]]
        return out


_SUMS = "bucket int, slice long, keys binary, counts binary, mass binary, lower binary, flags binary"
_SUMS_ARROW = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), *((c, pa.binary()) for c in ("keys", "counts", "mass", "lower", "flags"))])


def _sum_histories(order: int, stats: list[list[float] | None], buckets: int):
    """Of a slice's own n-grams, the seen mass and the lower-order mass of each history."""

    def run(key: tuple, slices: pa.Table, replies: pa.Table) -> pa.Table:
        g = Grams(slices.to_pylist()[0], _replies(replies), stats, order)
        below = g.level[order - 1].keys
        own = g.events(order, g.own[order])
        c, h = g.count[order][own], g.level[order].history[own]
        said, needed = g.said(order)
        mass = np.bincount(h, g.discounts[order].mass(c), len(below))[said]
        lower = np.bincount(h, g.seen(order - 1, g.level[order].suffix[own]), len(below))[said]
        flags = ((np.bincount(h, c <= MOST, len(below)) > 0) + 2 * needed).astype(np.uint8)[said]
        keys, count = below[said], g.count[order - 1][said].astype(np.uint64)
        of = slices.column("slice")[0].as_py()
        rows = [
            {"bucket": k, "slice": of, "keys": pack_keys(keys[a:z]), "counts": pack(count[a:z]), "mass": pack(mass[a:z]), "lower": pack(lower[a:z]), "flags": pack(flags[a:z])}
            for k, a, z in _cuts(keys, buckets)
        ]
        del g
        K.tidy()
        return pa.Table.from_pylist(rows, schema=_SUMS_ARROW)

    return run


def _weigh(order: int):
    """Backoff weights of one bucket of histories."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        bucket = table.column("bucket")[0].as_py()
        keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
        x = {c: np.concatenate([unpack(x, t) for x in table.column(c).to_pylist()]) for c, t in (("counts", np.uint64), ("mass", np.float64), ("lower", np.float64), ("flags", np.uint8))}
        size, every = np.array([len(k) for k in keys]), np.concatenate(keys)
        by = np.argsort(every, kind="stable")
        new = np.concatenate(([True], every[by][1:] != every[by][:-1]))
        first, of = np.flatnonzero(new), np.cumsum(new) - 1
        mass, lower = np.add.reduceat(x["mass"][by], first), np.add.reduceat(x["lower"][by], first)
        low, count = np.bitwise_or.reduceat(x["flags"][by], first) & 1, x["counts"][by][first].astype(np.float64)
        extra = ((low == 0) & (count > 0)).astype(np.uint8)
        left = 1 - mass / np.maximum(count + extra, 1)
        alpha = np.where(count > 0, left / np.maximum(1 - lower, 1e-300), 1.0)
        a, e = np.empty(len(of)), np.empty(len(of), np.uint8)
        a[by], e[by] = alpha[of], extra[of]
        needed = x["flags"] & 2 > 0
        end = np.cumsum(size)
        rows = [{"kind": -WEIGHTS - order, "bucket": bucket, "data": pack_keys(every[by][first][count > 0]), "more": pack(alpha[count > 0])}]
        for s, n, z in zip(table.column("slice").to_pylist(), size, end, strict=True):
            rows.append({"kind": WEIGHTS + order, "slice": s, "bucket": bucket, "data": pack(a[z - n : z][needed[z - n : z]]), "more": pack(e[z - n : z])})
        return pa.Table.from_pylist(rows, schema=_REPLY_ARROW)

    return run


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, stats: list[list[float] | None]):
    def run(key: tuple, slices: pa.Table, replies: pa.Table) -> pa.Table:
        g = Grams(slices.to_pylist()[0], _replies(replies), stats, order)
        s, u = g.slice, g.unigrams
        known = g.count[1][s.tokens]
        base = np.log10(known + 1) - np.log10(u.total + u.types + 1)
        p = np.log10(g.probability(order))[g.level[order].of]
        add = lambda x: np.add.reduceat(x, s.first)
        out = pa.table(
            [
                pa.array(s.ids, mask=~s.valid),
                pa.array(s.held),
                pa.array(s.sizes),
                pa.array(add((known > 0).astype(np.int64))),
                pa.array(np.full(len(s.ids), int(u.total))),
                pa.array(add(base)),
                pa.array(add(p)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )
        del g, s, p
        K.tidy()
        return out

    return run


def _stats(df: DataFrame, order: int) -> list[float] | None:
    rows = df.where(F.col("kind") == -order).select(*(F.sum(F.col("stats")[i]) for i in range(MOST + 3))).first()
    return None if rows[0] is None else [float(x) for x in rows]


def score(docs: DataFrame, held: Column | None = None, order: int = ORDER, bucket: int = BUCKET) -> DataFrame:
    """The model is learnt from the rows that are not held out; every row of (doc_id, text) is scored.

    The n-gram tables are the rows with a negative kind of the working tables
    (an order's n-grams; below -``WEIGHTS`` its backoff weights), partitioned by hash bucket.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (held_out(F.col("doc_id")) if held is None else held).alias("held_out"))
    slices = materialize(rows.mapInArrow(_slices, _SLICE), "slices")
    size = slices.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
    buckets = [0] + [max(12, -(-(n or 0) // bucket)) for n in (size.w, *[size.t] * (order - 1))]
    replies, stats = None, [None]
    for k in range(1, order + 1):
        counted = materialize(slices.mapInArrow(_ask(k, buckets[k]), _ASK).groupBy("bucket").applyInArrow(_answer(k), _REPLY), f"grams-{k}")
        stats.append(_stats(counted, k))
        own = counted.where(F.col("kind") == k).drop("stats")
        replies = own if replies is None else replies.unionAll(own)
        if k > 1:
            sums = slices.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(_sum_histories(k, stats, buckets[k - 1]), _SUMS)
            weights = materialize(sums.groupBy("bucket").applyInArrow(_weigh(k), _REPLY), f"weights-{k}")
            replies = replies.unionAll(weights.where(F.col("kind") == WEIGHTS + k).drop("stats"))
    return slices.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(_score(order, stats), _SCORE)
