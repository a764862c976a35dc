"""N-gram Jaccard join by PartEnum signatures.

A text's set is its distinct word shingles (64-bit hashes). Set sizes fall in
bands whose ends are at most 1 / similarity apart, so that similar sets are in
the same or in adjacent bands; a set is signed for its own band and the next.
In a band, similar sets differ in at most k shingles. The hash domain is cut
into n1 first-level partitions of three parts; by the pigeonhole principle
some partition holds at most one difference, so two of its three parts agree:
each partition signs each of its three pairs of parts. Pairs of empty parts
would be shared by very many sets; n1 has e partitions to spare, so that a set
with at most e blank partitions needn't sign them, and only sets with more
sign blanks as well. No similar pair is lost.

Signatures are dealt to buckets as packed arrays. Groups of a signature first
give pairs with their smallest member (a star). Pairs are tested by size, then
by a parity sketch that bounds the difference from below, then exactly. Groups
that have several components after that are tested in blocks of members by size
and sketch: first only the nearest members of each two components, then, with
the components that gives, every pair that may still be similar. Equal sets are one
class from the start, identified by a 64-bit hash of the set, and links inside
a component that is already known are not looked for.

Defined results: null and empty texts have the empty set and link with
nothing; a text with fewer words than a shingle has its sequence as its only
shingle; rows that repeat an id are one node; a null id is in no component
(null); an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import kernel as K
from lodestone.llm.components import components
from lodestone.runtime import drop, materialize

U64 = np.uint64
WORDS = 5
#: The threshold, in hundredths: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: Signatures that a bucket holds on average, buckets at least, members of a block, and of the groups of a task.
BUCKET, BUCKETS, BLOCK, SHARE = 1_000_000, 64, 2048, 20_000
#: Pairs of a task before repeated ones are dropped.
HELD = 300_000
#: Sets with at least 1 / HOT of all rows as copies sign once only.
HOT = 10_000
#: Needed ids up to this number are broadcast (8 bytes each), beyond it the texts are shuffled.
BROADCAST_IDS = 400_000


class Bands:
    """Size bands and their PartEnum parameters."""

    def __init__(self, similarity: int = SIMILARITY, largest: int = 1 << 40):
        low, self.right = 1, []
        while low <= largest:
            self.right.append(low * 100 // similarity)
            low = self.right[-1] + 1
        self.right = np.array([0, *self.right, low * 100 // similarity], np.int64)
        # |A xor B| <= (|A| + |B|) (100 - s) / (100 + s)
        self.k = 2 * self.right * (100 - similarity) // (100 + similarity)
        need = self.k // 2 + 1
        self.spare = np.where(self.k > 0, -(-need * 12 // 100) + 2, 0)
        self.n1 = need + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.right, n)


def set_ids(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit hash of each set (independent of order), as int64; 0 for the empty set."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(K.seeded(values, 7), out=total[1:])
    n = np.diff(offs)
    h = K.mix((total[offs[1:]] - total[offs[:-1]]) ^ K.mix(n.astype(np.uint64)))
    return np.where(n > 0, h, U64(0)).view(np.int64)


def sketches(values: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Parity bits: four times the set's size or more, a power of two. The number of bits
    in which two sketches differ is at most the number of differing shingles, and close to
    it: pairs below a similarity of about 0.79 are told apart from those at 0.8."""
    out = []
    hashed = K.seeded(values, 11)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        bits = 1 << max(8, int(4 * (b - a) - 1).bit_length()) if b > a else 256
        out.append(np.packbits((np.bincount((hashed[a:b] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes())
    return out


def fold(a: np.ndarray, words: int) -> np.ndarray:
    while len(a) > words:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def signatures(values: np.ndarray, offs: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, with the row of each."""
    n = np.diff(offs)
    own = bands.of(n)
    sigs, rows = [], []
    spread, weight = K.seeded(values, 3), K.seeded(values, 5)
    for step in (0, 1):
        tag = own + step
        use = np.flatnonzero((n > 0) & (bands.k[tag] > 0))
        if not len(use):
            continue
        t = tag[use]
        n1 = bands.n1[t]
        first = np.concatenate(([0], np.cumsum(3 * n1)))
        at = K.ranges(offs[use], n[use])
        owner = np.repeat(np.arange(len(use)), n[use])
        s = spread[at]
        p = ((s >> U64(32)) * n1.astype(np.uint64)[owner]) >> U64(32)
        q = ((s & U64(0xFFFFFFFF)) * U64(3)) >> U64(32)
        cells = np.zeros(int(first[-1]), np.uint64)
        np.add.at(cells, first[owner] + (p * U64(3) + q).astype(np.int64), weight[at])
        cells = cells.reshape(-1, 3)
        of = np.repeat(np.arange(len(use)), n1)
        part = np.arange(len(of)) - (first[:-1] // 3)[of]
        empty = cells == 0
        blanks = np.bincount(of, empty.sum(1) >= 2, len(use))
        unsafe = (blanks > bands.spare[t])[of]
        salt = K.mix(t[of].astype(np.uint64) * U64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
        for j, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
            keep = ~(empty[:, x] & empty[:, y]) | unsafe
            h = K.mix(cells[keep, x] * U64(0xA24BAED4963EE407) + K.mix(cells[keep, y] + U64(j + 1)) + salt[keep])
            sigs.append(h)
            rows.append(use[of[keep]])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(rows)


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            values, offs = K.shingle_sets(*K.texts(part.column("text")), words)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(offs)), pa.array(set_ids(values, offs)), pa.array(sketches(values, offs), pa.binary())],
                ["doc_id", "n", "cid", "sketch"],
            )

    return run


def _sign(words: int, similarity: int, buckets: int, hot: dict[int, int]):
    """hot: the set's id -> the one document that signs for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for part in K.slices(batches, "text"):
            values, offs = K.shingle_sets(*K.texts(part.column("text")), words)
            cid = set_ids(values, offs)
            sig, row = signatures(values, offs, bands)
            ids = part.column("doc_id").to_pylist()
            skip = np.array([d is None or hot.get(c, d) != d for c, d in zip(cid.tolist(), ids, strict=True)], bool)
            once, live = np.zeros(len(cid), bool), np.flatnonzero(~skip)  # a set signs once in a slice
            once[live[np.unique(cid[live], return_index=True)[1]]] = True
            keep = once[row]
            sig, row = sig[keep], row[keep]
            bucket = (((sig >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
            order = np.lexsort((row, bucket)) if buckets > 1 << 16 else np.argsort(bucket.astype(np.uint16), kind="stable")
            sig, row, bucket = sig[order].astype(np.uint32), row[order], bucket[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            end = np.append(cut[1:], len(bucket))[: len(cut)]
            member = cid[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut].astype(np.int32)), pa.array([sig[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary()), pa.array([member[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())],
                ["bucket", "sigs", "cids"],
            )

    return run


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()]) if len(column) else np.zeros(0, kind)


_FOUND = "kind int, bucket int, a long, b long, members binary, sizes binary"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary()), ("sizes", pa.binary())])


def _group(table: pa.Table) -> pa.Table:
    """Groups of one bucket: kind 0 are star pairs, kind 1 the groups of three or more members, packed."""
    bucket = table.column("bucket")[0].as_py()
    sig, cid = _joined(table.column("sigs"), np.uint32), _joined(table.column("cids"), np.int64)
    del table
    order = np.argsort(sig)
    sig = sig[order]
    again = np.zeros(len(sig) + 1, bool)
    again[1:-1] = sig[1:] == sig[:-1]
    shared = np.flatnonzero(again[1:] | again[:-1])
    sig, cid = sig[shared], cid[order[shared]]
    del order
    order = np.lexsort((cid, sig))
    sig, cid = sig[order], cid[order]
    if len(sig):
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])))
        sig, cid = sig[new], cid[new]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(sig)))
    anchor = np.repeat(cid[first], size) if len(sig) else cid
    pairs = np.unique(np.stack((anchor, cid), 1)[anchor != cid], axis=0) if len(sig) else np.zeros((0, 2), np.int64)
    large = size >= 3
    members = cid[K.ranges(first[large], size[large])]
    n = len(pairs)
    rows = [pa.table([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, bucket, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=_FOUND_ARROW)]
    if large.any():
        rows.append(pa.Table.from_pylist([{"kind": 1, "bucket": bucket, "members": members.tobytes(), "sizes": size[large].astype(np.uint32).tobytes()}], schema=_FOUND_ARROW))
    K.tidy()
    return pa.concat_tables(rows)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, members in zip(batch.column("bucket").to_pylist(), batch.column("members").to_pylist(), strict=True):
            cid = np.unique(np.frombuffer(members, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cid), bucket, np.int32)), pa.array(cid)], ["bucket", "cid"])


def _mixed(groups: pa.Table, labels: pa.Table) -> pa.Table:
    """Members of the groups of a bucket that lie in more than one component."""
    cid = labels.column("cid").to_numpy()
    order = np.argsort(cid)
    cid, root = cid[order], labels.column("root").to_numpy()[order]
    out_g, out_c = [], []
    for bucket, members, sizes in zip(*(groups.column(c).to_pylist() for c in ("bucket", "members", "sizes")), strict=True):
        members, sizes = np.frombuffer(members, np.int64), np.frombuffer(sizes, np.uint32).astype(np.int64)
        label = root[np.searchsorted(cid, members)]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        odd = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
        # groups with the same members are tested once
        total = np.add.reduceat(K.seeded(members.view(np.uint64), 17), first)
        gid = K.mix(total ^ sizes.astype(np.uint64) ^ (U64(bucket) << U64(32))).view(np.int64)
        _, unique = np.unique(gid, return_index=True)
        keep = np.intersect1d(unique, np.flatnonzero(odd))
        out_c.append(members[K.ranges(first[keep], sizes[keep])])
        out_g.append(np.repeat(gid[keep], sizes[keep]))
    return pa.table({"gid": pa.array(np.concatenate(out_g) if out_g else np.zeros(0, np.int64)), "cid": pa.array(np.concatenate(out_c) if out_c else np.zeros(0, np.int64))})


def _may_link(similarity: int):
    """Pairs that pass the tests by size and by sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = 100 * np.minimum(na, nb) >= similarity * np.maximum(na, nb)
            most = (na + nb) * (100 - similarity) // (100 + similarity)
            sa, sb = batch.column("sa"), batch.column("sb")
            for i in np.flatnonzero(ok):
                x, y = np.frombuffer(sa[i].as_py(), np.uint64), np.frombuffer(sb[i].as_py(), np.uint64)
                w = min(len(x), len(y))
                ok[i] = int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _close(cid: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, sk: list[np.ndarray], similarity: int, nearest: bool) -> np.ndarray:
    """Pairs of one group's members in different components that pass by size and
    sketch, with their components and the number of differing bits."""
    words = min(map(len, sk))
    # members of one group differ little in size; all are folded to the shortest sketch
    m = np.stack([fold(x, words) for x in sk])
    roots, size = np.unique(root, return_counts=True)
    main, here = root == roots[np.argmax(size)], np.arange(len(cid))
    out = [np.zeros((0, 5), np.int64)]
    # pairs inside the largest component aren't asked for: one side is always outside of it
    for i in np.flatnonzero(~main):
        j = np.flatnonzero((root != root[i]) & (main | (here > i)) & ((side != side[i]) | (side == 2)))
        j = j[100 * np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i])]
        if not len(j):
            continue
        d = np.bitwise_count(m[j] ^ m[i]).sum(1, dtype=np.int64)
        ok = d <= (n[j] + n[i]) * (100 - similarity) // (100 + similarity)
        j, d = j[ok], d[ok]
        if nearest and len(j) > 1:
            order = np.lexsort((d, root[j]))
            j, d = j[order], d[order]
            keep = np.concatenate(([True], root[j][1:] != root[j][:-1]))
            j, d = j[keep], d[keep]
        if len(j):
            out.append(np.stack((np.minimum(root[j], root[i]), np.maximum(root[j], root[i]), d, np.minimum(cid[j], cid[i]), np.maximum(cid[j], cid[i])), 1))
    return np.concatenate(out)


def _once(found: np.ndarray, nearest: bool) -> np.ndarray:
    """Each pair once; nearest: each two components once, by their nearest pair."""
    if len(found) > 1:
        found = found[np.lexsort(found.T[::-1])]
        keys = found[:, :2] if nearest else found[:, 3:]
        found = found[np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))]
    return found


def _blocks(similarity: int, nearest: bool):
    """The close pairs of some groups, each once; nearest: of each two components the
    one with the fewest differing bits."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("gid", "ascending"), ("cid", "ascending")])
        gid, cid, n, root, side = (table.column(c).to_numpy() for c in ("gid", "cid", "n", "root", "side"))
        sk = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        cut = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
        parts, held = [], 0
        for a, b in zip(cut, [*cut[1:], len(gid)], strict=True):
            parts.append(_close(cid[a:b], n[a:b], root[a:b], side[a:b], sk[a:b], similarity, nearest))
            held += len(parts[-1])
            if held > HELD:
                parts = [_once(np.concatenate(parts), nearest)]
                held = len(parts[0]) // 2
        found = _once(np.concatenate(parts), nearest)[:, 3:]
        K.tidy()
        return pa.table({"a": pa.array(found[:, 0].copy()), "b": pa.array(found[:, 1].copy())})

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            values, offs = K.shingle_sets(*K.texts(part.column("text")), words)
            own = np.flatnonzero(set_ids(values, offs) == part.column("cid").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column("cid").take(pa.array(own)), pa.array([values[offs[i] : offs[i + 1]].tobytes() for i in own], pa.binary())], ["cid", "elements"])

    return run


def _exact(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, left, of = np.zeros(batch.num_rows, bool), None, None
            a, ea, eb = batch.column("a").to_pylist(), batch.column("ea"), batch.column("eb")
            for i in range(batch.num_rows):
                if of != a[i]:
                    left, of = np.frombuffer(ea[i].as_py(), np.uint64), a[i]
                right = np.frombuffer(eb[i].as_py(), np.uint64)
                both = np.sort(np.concatenate((left, right)), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * inter >= similarity * (len(both) - inter)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, similarity: int, sketched: bool = False) -> DataFrame:
    """Those of the distinct pairs that are similar enough (materialised)."""
    if not sketched:
        side = classes.select("cid", "n", "sketch")
        pairs = (
            pairs.join(side.toDF("a", "na", "sa"), "a")
            .join(side.toDF("b", "nb", "sb"), "b")
            .select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(_may_link(similarity), "a long, b long")
        )
    pairs = materialize(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select("b")).distinct().join(classes.select("cid", "rep"), "cid").select("cid", F.col("rep").alias("doc_id"))
    needed = materialize(needed, "needed")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    # a repeated id may have several texts; the class's own is told by its set
    sets = docs.select("doc_id", "text").join(needed, "doc_id").select("cid", "text").mapInArrow(_sets(words), "cid long, elements binary")
    sets = materialize(sets.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("elements").alias("elements")), "sets")
    both = pairs.join(sets.toDF("b", "eb"), "b").join(sets.toDF("a", "ea"), "a").select("a", "b", "ea", "eb")
    links = materialize(both.mapInArrow(_exact(similarity), "a long, b long"), "links")
    for x in (pairs, needed, sets):
        drop(x)
    return links


def _between(found: DataFrame, roots: DataFrame, classes: DataFrame, similarity: int, nearest: bool) -> DataFrame:
    """Distinct pairs of a signature's members in different components that may be similar."""
    groups = found.where("kind = 1").select("bucket", "members", "sizes")
    labels = groups.select("bucket", "members").mapInArrow(_members, "bucket int, cid long").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = materialize(groups.groupBy("bucket").cogroup(labels.groupBy("bucket")).applyInArrow(_mixed, "gid long, cid long"), "mixed")
    # a group of m members is cut into m / BLOCK chunks, and each pair of chunks is a task's work
    chunks = mixed.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    side = classes.select("cid", "n", "sketch").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", "sketch", F.coalesce("root", "cid").alias("root"))
    # small groups share tasks, where pairs that several groups have are found once
    tasks = -(-mixed.count() // SHARE)
    dealt = (
        mixed.join(chunks, "gid")
        .withColumn("g", F.when(F.col("k") > 1, F.col("gid")).otherwise(F.pmod("gid", F.lit(max(tasks, 1)))))
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("g", "gid", "cid", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
        .join(side, "cid")
    )
    return dealt.groupBy("g", "x", "y").applyInArrow(_blocks(similarity, nearest), "a long, b long").distinct()


def join(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = materialize(docs.mapInArrow(_describe(words), "doc_id long, n long, cid long, sketch binary"), "described")
    classes = materialize(
        every.where("n > 0 and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes"
    )
    total = every.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    buckets = max(BUCKETS, -(-(total.n or 0) // bucket))
    floor = max(64, total.rows // HOT)
    hot = {r.cid: r.rep for r in classes.where(F.col("copies") >= floor).select("cid", "rep").collect()}  # HOT rows at most

    dealt = docs.mapInArrow(_sign(words, similarity, buckets, hot), "bucket int, sigs binary, cids binary")
    found = materialize(dealt.groupBy("bucket").applyInArrow(_group, _FOUND), "found")
    links = _verify(found.where("kind = 0").select("a", "b").distinct(), docs, classes, words, similarity)
    # stars join most of what belongs together; then the nearest members of different
    # components of a group, and at last whatever pairs may still link two components
    for nearest in (True, False):
        roots = materialize(components(links), "roots")
        rest = _between(found, roots, classes, similarity, nearest)
        more = _verify(rest, docs, classes, words, similarity, sketched=True)
        links = links.unionAll(more)
    roots = components(links)

    component = (
        classes.select("cid", "rep").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    )
    component = materialize(component, "component")
    least = component.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = component.join(least, "root").select("cid", "component_id")
    # rows that repeat an id are one node: they share the smallest component
    out = every.select("doc_id", "n", "cid").join(component, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    drop(found)
    return out


def keep_one(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The documents without those that are linked, directly or not, with one of a
    smaller id; of rows that repeat an id with words, the one with the least text stays
    (of equal texts, that with the least hash of all columns). Rows with a null id stay."""
    joined = join(docs, words, similarity)
    out = materialize(joined.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "kept")
    kept = docs.join(out.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti")
    if out.where("rows > 1").limit(1).count():
        repeated = out.where("rows > 1 and component_id = doc_id").select("doc_id")
        every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        some = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(every, F.struct("text", F.xxhash64(every))).alias("row"))
        once = some.select("row.*")
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
