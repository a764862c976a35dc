"""Exact substring deduplication over a blockwise suffix order with a difference cover.

Every byte of a document that lies in a string of ``width`` bytes which also
starts in a document with a smaller id is removed. Four steps keep the suffix
sort to what may repeat at all:

1. A document whose whole text equals that of a smaller id goes entirely (if
   it has ``width`` bytes) and takes no further part.
2. Each window of ``width`` bytes has its minimiser, the q-gram with the least
   hash. Windows next to each other with the same minimiser form a fragment
   (the bytes that they cover). Equal windows have equal minimisers, so a
   window repeats only if its minimiser's gram does. Per fragment, the hashes of
   gram and fragment go to buckets as packed arrays: where a whole fragment
   also occurs in a smaller id, all of its windows go.
3. Where a gram repeats in different fragments, one document of each different
   fragment sends its bytes to a suffix bucket. There the suffixes with a whole
   window are ordered: ranks of a difference-cover sample are computed first,
   then one bucket of suffixes with a common beginning is sorted at a time, and
   ties beyond its first bytes are resolved by the sample's ranks. Equal windows
   are neighbours in that order. Grams with very many different fragments go
   through an aggregation by window instead, whose partial sums spread them.
4. The documents concerned are read again and the marked windows cut out.

Defined results: a null text is empty; texts below ``width`` bytes stay whole;
rows with a null id stay whole and remove nothing; rows that repeat an id don't
remove each other; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel as K
from lodestone.runtime import drop, materialize

U64 = np.uint64
WIDTH, GRAM = 50, 20
#: Text handled at once, hash buckets at least, fragments of a hash bucket and of a suffix bucket.
PIECE, BUCKETS, BUCKET, SUFFIX_BUCKET = 1 << 19, 64, 500_000, 8_000
#: Grams with more different fragments than this are aggregated by window.
HOT = 8_000
BROADCAST_IDS = 400_000
#: A perfect difference set modulo 13 (all differences occur).
PERIOD, COVER = 13, (0, 1, 3, 9)


def fragments(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: first and last window of each fragment, hash of its minimiser, hash of its bytes."""
    out: list[tuple] = []
    n = len(data)
    for a in range(0, max(n - width + 1, 0), PIECE):
        b = min(n, a + PIECE + width - 1)
        part = data[a:b]
        m = len(part)
        value = K._BYTE[part] * K._power(K._BASE, m)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        inverse = K._power(K._BASE_INVERSE, m + 1)
        grams = K.mix((total[gram:] - total[:-gram]) * inverse[: m - gram + 1])
        low = U64((1 << 21) - 1)
        key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span, reach = width - gram + 1, 1
        while reach < span:
            step = min(reach, span - reach)
            key = np.minimum(key[:-step], key[step:])
            reach += step
        at = (key & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        whole = K.mix((total[last + width] - total[first]) * inverse[first] + K.mix((last - first).astype(np.uint64)))
        out.append((first + a, last + a, grams[at[first]], whole))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches, "text", 2 << 20):
        data, offs = K.texts(part.column("text"))
        sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs)), pa.array(sha)], ["doc_id", "n_bytes", "sha256"])


def _deal(width: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text", 2 << 20):
            data, offs = K.texts(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            found = [(i, *fragments(data[a:b], width, gram)[2:]) for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)) if b - a >= width]
            if not found:
                continue
            doc = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            g, w = (np.concatenate([f[k] for f in found]) for k in (1, 2))
            bucket = (((g >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            g, w, doc, bucket = g[order].astype(np.uint32), w[order], ids[doc[order]].astype(np.int64), bucket[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            end = np.append(cut[1:], len(bucket))
            cols = [pa.array([x[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary()) for x in (g, w, doc)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), *cols], ["bucket", "grams", "wholes", "docs"])

    return run


_MARKS = "doc_id long, full binary, partial binary, n_partial int"
_MARKS_ARROW = pa.schema([("doc_id", pa.int64()), ("full", pa.binary()), ("partial", pa.binary()), ("n_partial", pa.int32())])


def _mark(table: pa.Table) -> pa.Table:
    """Of one bucket, per document: fragments that go entirely, fragments to be looked into."""
    K.tidy()
    g, w, doc = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("grams", np.uint32), ("wholes", np.uint64), ("docs", np.int64)))
    del table
    order = np.argsort(g)
    g = g[order]
    again = np.zeros(len(g) + 1, bool)
    again[1:-1] = g[1:] == g[:-1]
    shared = np.flatnonzero(again[1:] | again[:-1])
    g, order = g[shared], order[shared]
    w, doc = w[order], doc[order]
    order = np.lexsort((doc, w, g))
    g, w, doc = g[order], w[order], doc[order]
    if len(g):
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])))
        g, w, doc = g[new], w[new], doc[new]
    if not len(g):
        return _MARKS_ARROW.empty_table()
    newg = np.concatenate(([True], g[1:] != g[:-1]))
    neww = newg | np.concatenate(([True], w[1:] != w[:-1]))
    ofg, firstg = np.cumsum(newg) - 1, np.flatnonzero(newg)
    many = (np.minimum.reduceat(doc, firstg) != np.maximum.reduceat(doc, firstg)) & (np.add.reduceat(neww.astype(np.int64), firstg) > 1)
    full = ~neww  # sorted by document, the first of a fragment has the least id
    partial = neww & many[ofg]
    keep = np.flatnonzero(full | partial)
    keep = keep[np.lexsort((full[keep], doc[keep]))]
    doc, w, full = doc[keep], w[keep], full[keep]
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(doc))[: len(cut)]
    mid = cut + np.add.reduceat((~full).astype(np.int64), cut) if len(cut) else cut
    return pa.table(
        [pa.array(doc[cut]), pa.array([w[m:e].tobytes() for m, e in zip(mid, end, strict=True)], pa.binary()), pa.array([w[c:m].tobytes() for c, m in zip(cut, mid, strict=True)], pa.binary()), pa.array((mid - cut).astype(np.int32))],
        schema=_MARKS_ARROW,
    )


def _wanted(parts: list[bytes] | None) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(x for x in parts if x), np.uint64)) if parts else np.zeros(0, np.uint64)


def _cut_out(width: int, gram: int):
    """The bytes of the fragments that are to be looked into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text", 2 << 20):
            data, offs = K.texts(part.column("text"))
            ids, wanted = part.column("doc_id").to_pylist(), part.column("partial")
            rows = []
            for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
                text = data[a:b]
                first, last, g, w = fragments(text, width, gram)
                _, once = np.unique(w, return_index=True)
                for k in once[np.isin(w[once], _wanted(wanted[i].as_py()))].tolist():
                    rows.append((int(g[k].view(np.int64)), ids[i], int(w[k].view(np.int64)), text[first[k] : last[k] + width].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["gram", "doc_id", "whole", "bytes"])

    return run


def _prefix(text: np.ndarray, at: np.ndarray, length: int = 8) -> np.ndarray:
    """``length`` (8 at most) bytes from each position as a number; text must be padded."""
    out = np.zeros(len(at), np.uint64)
    for t in range(length):
        out = (out << U64(8)) | text[at + t].astype(np.uint64)
    return out


class CoverRanks:
    """Ranks of the suffixes at a difference-cover sample of positions: by their first
    ``depth`` bytes, then doubled over whole periods until no ties are left."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        depth = -(-depth // PERIOD) * PERIOD
        padded = np.concatenate((text, np.zeros(depth + 2 * PERIOD + 8, np.uint8)))
        sample = np.sort(np.concatenate([np.arange(r, n + PERIOD, PERIOD) for r in COVER]))
        columns = [_prefix(padded, sample + t, min(8, depth - t)) for t in range(0, depth, 8)]
        order = np.lexsort(columns[::-1])
        change = np.ones(len(order), bool)
        change[1:] = False
        for c in columns:
            change[1:] |= c[order[1:]] != c[order[:-1]]
        self.rank = np.zeros(n + 2 * PERIOD, np.int64)
        while True:
            self.rank[sample[order]] = np.cumsum(change)
            if change.all() or depth >= 2 * n:
                break
            first = self.rank[sample]
            beyond = sample + depth
            second = np.where(beyond < len(self.rank), self.rank[np.minimum(beyond, len(self.rank) - 1)], 0)
            order = np.lexsort((second, first))
            change[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
            depth *= 2
        # what only the padding makes equal goes by position
        self.rank[sample[order]] = np.arange(1, len(order) + 1)
        inside = np.isin(np.arange(PERIOD), COVER)
        #: for two residues the least step after which both positions are in the sample
        self.step = np.array([[next(d for d in range(PERIOD) if inside[(x + d) % PERIOD] and inside[(y + d) % PERIOD]) for y in range(PERIOD)] for x in range(PERIOD)])

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y; both share their first PERIOD bytes."""
        d = self.step[x % PERIOD, y % PERIOD]
        return self.rank[x + d] < self.rank[y + d]


def _sort_ties(at: np.ndarray, group: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """Merge sort of all tie groups at once; group: ordinal of each position's group, ascending."""
    n = len(at)
    start = np.searchsorted(group, group, side="left")
    end = np.searchsorted(group, group, side="right")
    width = 1
    largest = int((end - start).max(initial=1))
    here = np.arange(n)
    while width < largest:
        run = (here - start) // width
        left = run % 2 == 0
        other = start + np.where(left, run + 1, run - 1) * width
        lo = np.minimum(other, end)
        hi = np.minimum(other + width, end)
        base = lo.copy()
        while True:  # how many of the other run come before each position
            open_ = lo < hi
            if not open_.any():
                break
            mid = np.where(open_, (lo + hi) // 2, 0)
            m = at[mid]
            before = np.where(left, ranks.less(m, at), ~ranks.less(at, m)) & open_
            lo = np.where(before, mid + 1, lo)
            hi = np.where(open_ & ~before, mid, hi)
        own = here - (start + run * width)
        to = start + (run // 2) * 2 * width + own + (lo - base)
        out = np.empty_like(at)
        out[to] = at
        at = out
        width *= 2
    return at


def suffix_order(text: np.ndarray, at: np.ndarray, depth: int, bucket: int = 1 << 16) -> Iterator[np.ndarray]:
    """The suffixes at the positions, in order of at least their first ``depth`` bytes,
    one bucket at a time; suffixes with equal beginnings are in the same bucket."""
    ranks = CoverRanks(text, depth)
    padded = np.concatenate((text, np.zeros(depth + PERIOD + 8, np.uint8)))
    head = _prefix(padded, at)
    order = np.argsort(head, kind="stable")
    at, head = at[order], head[order]
    lo = 0
    while lo < len(at):
        hi = int(np.searchsorted(head, head[min(lo + bucket, len(at)) - 1], side="right"))
        x = at[lo:hi]
        tail = _prefix(padded, x + 8, PERIOD - 8)
        order = np.lexsort((tail, head[lo:hi]))
        x, h, tail = x[order], head[lo:hi][order], tail[order]
        group = np.cumsum(np.concatenate(([0], ((h[1:] != h[:-1]) | (tail[1:] != tail[:-1])).astype(np.int64))))
        yield _sort_ties(x, group, ranks)
        lo = hi


_FOUND = "doc_id long, whole long, windows binary"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("whole", pa.int64()), ("windows", pa.binary())])


def _look_into(width: int):
    """Windows (offsets in their fragment) that also start in a smaller id, by the suffix order of the fragments."""

    def run(table: pa.Table) -> pa.Table:
        K.tidy()
        data, offs = K.texts(table.column("bytes").combine_chunks())
        doc, whole = table.column("doc_id").to_numpy(), table.column("whole").to_numpy()
        # a window whose hash no other document has can't repeat; only fragments with others are sorted
        size = np.diff(offs) - width + 1
        at, owner = K.ranges(offs[:-1], size), np.repeat(np.arange(len(size)), size)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(K._BYTE[data] * K._power(K._BASE, len(data)), out=total[1:])
        h = (total[at + width] - total[at]) * K._power(K._BASE_INVERSE, len(data) + 1)[at]
        order = np.argsort(h, kind="stable")
        h, d = h[order], doc[owner[order]]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        keep = np.sort(order[np.repeat(several, np.diff(np.append(first, len(h))))])
        at, owner = at[keep], owner[keep]
        del total, h, d, order
        if not len(at):
            return _FOUND_ARROW.empty_table()
        rows = np.unique(owner)
        length = np.diff(offs)[rows]
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        data = data[K.ranges(offs[:-1][rows], length)]
        new = np.searchsorted(rows, owner)
        at = at - offs[:-1][owner] + begin[new]
        doc, whole, offs, owner = doc[rows], whole[rows], np.append(begin, len(data)), new
        where = np.full(len(data), -1, np.int64)
        where[at] = owner
        hit_at = []
        view = np.lib.stride_tricks.sliding_window_view(data, width)
        for x in suffix_order(data, at, width):
            same = np.zeros(len(x), bool)
            for a in range(1, len(x), 1 << 16):
                b = min(len(x), a + (1 << 16))
                same[a:b] = (view[x[a:b]] == view[x[a - 1 : b - 1]]).all(1)
            first = np.flatnonzero(~same)
            d = doc[where[x]]
            least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(x))))
            hit_at.append(x[d > least])
        hits = np.sort(np.concatenate(hit_at)) if hit_at else np.zeros(0, np.int64)
        of = where[hits]
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        end = np.append(cut[1:], len(of))[: len(cut)]
        rel = (hits - offs[of]).astype(np.uint32)
        return pa.table([pa.array(doc[of[cut]]), pa.array(whole[of[cut]]), pa.array([rel[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())], schema=_FOUND_ARROW)

    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, w, t, x[t : t + width]) for d, w, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "whole", "bytes")), strict=True) for t in range(len(x) - width + 1)]
            for a in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 50_000], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "whole", "t", "window"])

    return run


def spans(mark: np.ndarray) -> np.ndarray:
    """Start and end of each run of marked bytes."""
    edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), 1)


def _assemble(width: int, gram: int):
    """Per document: removed spans and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text", 2 << 20):
            data, offs = K.texts(part.column("text"))
            full, wholes, windows = part.column("full"), part.column("wholes"), part.column("windows")
            rows = []
            for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
                text = data[a:b]
                first, last, _, w = fragments(text, width, gram)
                depth = np.zeros(len(text) + 1, np.int64)
                goes = np.isin(w, _wanted(full[i].as_py()))
                np.add.at(depth, first[goes], 1)
                np.add.at(depth, last[goes] + width, -1)
                more = wholes[i].as_py()
                if more:
                    known = dict(zip(more, windows[i].as_py(), strict=True))
                    for k in np.flatnonzero(np.isin(w.view(np.int64), np.array(more, np.int64))).tolist():
                        at = first[k] + np.frombuffer(known[int(w[k].view(np.int64))], np.uint32).astype(np.int64)
                        np.add.at(depth, at, 1)
                        np.add.at(depth, at + width, -1)
                mark = np.cumsum(depth[:-1]) > 0
                rows.append((int(mark.sum()), spans(mark).astype(np.int64).tobytes(), hashlib.sha256(text[~mark].tobytes()).hexdigest()))
            removed, runs, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(removed, pa.int64()), pa.array([len(r) // 16 for r in runs], pa.int64()), pa.array(sha), pa.array(runs, pa.binary())], ["doc_id", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (packed int64 pairs, null if none or all) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = materialize(docs.mapInArrow(_describe, "doc_id long, n_bytes long, sha256 string"), "described")
    known = every.where("doc_id is not null")
    texts = known.groupBy("sha256").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    # copies are told by their text's hash; they neither send nor receive anything
    copies = materialize(known.join(texts, "sha256").where("doc_id > least").select("doc_id", "sha256").distinct(), "copies")
    total = every.agg(F.sum("n_bytes").alias("n")).first().n or 0
    buckets = max(BUCKETS, -(-total * 2 // (width - gram + 2) // BUCKET))

    few = copies.count() <= BROADCAST_IDS
    gone = copies.select("doc_id").distinct()
    live = docs.where("doc_id is not null").join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    dealt = live.mapInArrow(_deal(width, gram, buckets), "bucket int, grams binary, wholes binary, docs binary")
    marks = materialize(dealt.groupBy("bucket").applyInArrow(_mark, _MARKS), "marks")

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = materialize(ids.distinct(), "ids")
        out = live.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        return out

    partial = marks.where("n_partial > 0")
    cut = texts_of(partial.select("doc_id")).join(partial.groupBy("doc_id").agg(F.collect_list("partial").alias("partial")), "doc_id")
    pieces = materialize(cut.select("doc_id", "text", "partial").mapInArrow(_cut_out(width, gram), "gram long, doc_id long, whole long, bytes binary"), "pieces")
    groups = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    hot = materialize(groups.where(F.col("n") > HOT).select("gram"), "hot")
    number = max(16, -(-pieces.count() // SUFFIX_BUCKET))
    if hot.limit(1).count():
        common = pieces.join(hot, "gram", "left_semi")
        cool = pieces.join(hot, "gram", "left_anti")
        rows = materialize(common.select("doc_id", "whole", "bytes").mapInArrow(_windows(width), "doc_id long, whole long, t int, window binary"), "windows")
        least = rows.groupBy("window").agg(F.min("doc_id").alias("least"))
        hits = rows.join(least, "window").where("doc_id > least").select("doc_id", "whole", "t")
        more = hits.groupBy("doc_id", "whole").agg(F.array_join(F.transform(F.collect_set("t"), lambda t: F.lpad(F.hex(t), 8, "0")), "").alias("x"))
        more = more.select("doc_id", "whole", F.unhex("x").alias("windows")).mapInArrow(_swap, _FOUND)
    else:
        cool, more = pieces, None
    found = cool.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(number)).cast("int")).groupBy("bucket").applyInArrow(_look_into(width), _FOUND)
    found = materialize(found.unionAll(more) if more is not None else found, "found")

    full = marks.where(F.octet_length("full") > 0)
    concerned = texts_of(full.select("doc_id").unionAll(found.select("doc_id")))
    both = (
        concerned.join(full.groupBy("doc_id").agg(F.collect_list("full").alias("full")), "doc_id", "left")
        .join(found.groupBy("doc_id").agg(F.collect_list(F.struct("whole", "windows")).alias("f")), "doc_id", "left")
        .select("doc_id", "text", "full", F.col("f.whole").alias("wholes"), F.col("f.windows").alias("windows"))
    )
    # repeated ids may have several texts: results go back to their own by the text's hash
    result = materialize(_with_sha(both, width, gram), "removed")
    for x in (marks, pieces, found):
        drop(x)
    is_copy = F.col("copy").isNotNull() & (F.col("n_bytes") >= width)
    all_gone = F.sha2(F.lit("").cast("binary"), 256)
    return (
        every.join(result, ["doc_id", "sha256"], "left")
        .join(copies.select("doc_id", "sha256", F.lit(True).alias("copy")), ["doc_id", "sha256"], "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(is_copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(is_copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(is_copy, all_gone).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
            F.when(~is_copy, F.col("spans")).alias("spans"),
        )
    )


def _swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Big-endian offsets to the native order."""
    for batch in batches:
        windows = [np.frombuffer(x, ">u4").astype(np.uint32).tobytes() for x in batch.column("windows").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("whole"), pa.array(windows, pa.binary())], ["doc_id", "whole", "windows"])


def _with_sha(both: DataFrame, width: int, gram: int) -> DataFrame:
    inner = _assemble(width, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text", 2 << 20):
            data, offs = K.texts(part.column("text"))
            sha = pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)])
            for out in inner(iter([part])):
                yield pa.RecordBatch.from_arrays([*out.columns, sha], [*out.schema.names, "sha256"])

    return both.mapInArrow(run, "doc_id long, n_removed long, n_spans long, kept_sha256 string, spans binary, sha256 string").dropDuplicates(["doc_id", "sha256"])
