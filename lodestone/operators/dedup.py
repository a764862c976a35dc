"""Exact and near-duplicate removal of chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.runtime import drop, materialize

#: Similarity, permutations, and the bands that suit them.
THRESHOLD, PERMUTATIONS, BANDS = 0.85, 128, 8
#: Buckets by which words are counted, parity bits of a word set, ids of chunks that are broadcast.
BUCKETS, BITS, BROADCAST_IDS = 1 << 17, 512, 400_000


def exact(chunks: DataFrame, scope: str = "file") -> DataFrame:
    """The first chunk of each content, by file (``source``) or over all ("global")."""
    keys = [F.sha2("content", 256).alias("content_hash")] + ([F.col("source")] if scope == "file" else [])
    first = chunks.groupBy(*keys).agg(F.min("chunk_id").alias("chunk_id"))
    return first.select("chunk_id", "content_hash")


def word_sets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, word): distinct lower-cased words."""
    return chunks.select("chunk_id", "source", F.explode(F.array_distinct(T.words(F.lower("content")))).alias("word"))


def classes(chunks: DataFrame, scope: str = "file") -> DataFrame:
    """(chunk_id, content_hash, rep, rep_hash): the first chunk with the same word set, by file or over all, and its content's hash.

    A chunk without words is like those of the same content only.
    """
    rows = chunks.select("chunk_id", "source", F.sha2("content", 256).alias("content_hash"), F.lower("content").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text, low in zip(batch.column("content_hash").to_pylist(), batch.column("low").to_pylist(), strict=True):
                words = None if low is None else set(low.split())
                keys.append(None if words is None else hashlib.sha256("\x01".join(sorted(words)).encode()).hexdigest() if words else f"={text}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk_id", "source", "content_hash")), pa.array(keys, pa.string())], ["chunk_id", "source", "content_hash", "key"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = materialize(rows.mapInArrow(run, f"chunk_id {kind}, source string, content_hash string, key string"), "keys")
    by = ["key"] + (["source"] if scope == "file" else [])
    first = rows.groupBy(*by).agg(F.min("chunk_id").alias("rep"), F.min_by("content_hash", "chunk_id").alias("rep_hash"))
    return rows.join(first, by).select("chunk_id", "content_hash", "rep", "rep_hash")


def representatives(chunks: DataFrame, scope: str = "file") -> DataFrame:
    """The chunks that are the first with their word set: copies aren't paired with copies."""
    return chunks.join(classes(chunks, scope).where("chunk_id = rep").select("chunk_id"), "chunk_id", "left_semi")


def _hashed(low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct words of lower-cased texts, and 64-bit hashes of these words; white space is that of ``T.WS``."""
    words = [list(set(t.split())) if t else [] for t in low.to_pylist()]
    flat = np.array([w for x in words for w in x], object)
    return np.array([len(x) for x in words], np.int64), pd.util.hash_array(flat, categorize=False).view(np.int64) if len(flat) else np.zeros(0, np.int64)


def _prefixes(chunks: DataFrame, threshold: float) -> DataFrame:
    """(chunk_id, source, n, places, words, sketch): size, prefix and parity bits of each chunk's set of word hashes.

    Words are in the order of how often their bucket occurs, which is any total
    order as far as results go. Those that occur once aren't listed.
    """
    spark = chunks.sparkSession
    low = chunks.select("chunk_id", "source", F.lower("content").alias("low"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            often += np.bincount(_hashed(batch.column("low"))[1] % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(often[some])], ["bucket", "n"])

    often = np.zeros(BUCKETS, np.int64)
    found = low.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    often[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            n, h = _hashed(batch.column("low"))
            row = np.repeat(np.arange(len(n)), n)
            bits = (np.bincount(row * BITS + ((h >> 32) & (BITS - 1)), minlength=len(n) * BITS) & 1).astype(np.uint8)
            sketch = np.packbits(bits).view(np.int64)
            df = often[h % BUCKETS]
            order = np.lexsort((h, df, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + 1
            listed = np.flatnonzero((place <= (n - np.ceil(threshold * n) + 1)[row]) & (df[order] > 1))
            ends = np.append(0, np.cumsum(np.bincount(row[listed], minlength=len(n)))).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place[listed].astype(np.int32), h[order][listed]))
            words = BITS // 64
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * words, words, dtype=np.int32)), pa.array(sketch))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("source"), pa.array(n.astype(np.int32)), *lists, each], ["chunk_id", "source", "n", "places", "words", "sketch"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return low.mapInArrow(run, f"chunk_id {kind}, source string, n int, places array<int>, words array<long>, sketch array<long>")


def similar_pairs(chunks: DataFrame, threshold: float = THRESHOLD, scope: str = "file") -> DataFrame:
    """Pairs (a < b) of the first chunks of their word sets with a Jaccard similarity of at least the threshold.

    Prefix filter: sets that similar share one of their rarest n - ceil(t n) + 1
    words, after the first of which both have enough words left. Parity bits of
    the sets, which differ in no more places than the sets do, leave few of
    these candidates; their words are compared. Only these chunks' texts are moved.
    """
    t = F.lit(threshold)
    first = classes(chunks, scope).where("chunk_id = rep").select("chunk_id")
    packed = materialize(_prefixes(chunks, threshold).where("n > 0").join(first, "chunk_id", "left_semi"), "prefixes")
    prefix = packed.select("chunk_id", *(["source"] if scope == "file" else []), "n", F.explode(F.arrays_zip("places", "words")).alias("x")).select("*", "x.places", "x.words").drop("x")
    a, b = prefix.alias("a"), prefix.alias("b")
    on = (F.col("a.words") == F.col("b.words")) & (F.col("a.chunk_id") < F.col("b.chunk_id")) & (F.least("a.n", "b.n") >= t * F.greatest("a.n", "b.n"))
    # of n words in both together, this many are common to similar sets (less what rounding may add)
    on = on & (1 + F.least(F.col("a.n") - F.col("a.places"), F.col("b.n") - F.col("b.places")) >= t / (1 + t) * (F.col("a.n") + F.col("b.n")) - 1e-6)
    if scope == "file":
        on = on & (F.col("a.source") == F.col("b.source"))
    pairs = a.join(b, on).select(F.col("a.chunk_id").alias("a"), F.col("b.chunk_id").alias("b")).distinct()
    x, y = (packed.select(F.col("chunk_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda s, d: s + d)
    pairs = pairs.join(x, "a").join(y, "b").where(apart <= (1 - t) / (1 + t) * (F.col("na") + F.col("nb")) + 1e-6).select("a", "b")
    pairs = materialize(pairs, "candidates")
    some = materialize(pairs.select(F.col("a").alias("chunk_id")).unionAll(pairs.select("b")).distinct(), "ids")
    # the ids are broadcast where they are few, so that other texts stay where they are
    texts = chunks.join(F.broadcast(some) if some.count() <= BROADCAST_IDS else some, "chunk_id", "left_semi")
    return _similar(texts, pairs).where(F.col("jaccard") >= t).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _similar(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of pairs of chunks."""
    whole = chunks.select("chunk_id", F.array_distinct(T.words(F.lower("content"))).alias("words"))
    both = pairs.join(whole.toDF("a", "wa"), "a").join(whole.toDF("b", "wb"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.select("a", "b", (common / (F.size("wa") + F.size("wb") - common)).alias("jaccard"))


def first_wins(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk_id, kept): in order of id, a chunk stays unless a kept earlier one is similar.

    The fixpoint of: kept if all earlier neighbours are removed, removed if an
    earlier neighbour is kept. Each round decides the least undecided id of
    every neighbourhood at least.
    """
    edges = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar")
    state = materialize(edges.select(F.col("b").alias("chunk_id")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "state")
    while True:
        # ids without an earlier neighbour aren't in ``state`` and are kept
        earlier = edges.join(state.toDF("a", "kept_a"), "a", "left").join(state.select("chunk_id", F.lit(True).alias("known")).toDF("a", "in_state"), "a", "left")
        earlier = earlier.withColumn("kept_a", F.when(F.col("in_state"), F.col("kept_a")).otherwise(F.lit(True)))
        seen = earlier.groupBy(F.col("b").alias("chunk_id")).agg(F.coalesce(F.bool_or("kept_a"), F.lit(False)).alias("some"), (F.count("kept_a") == F.count("*")).alias("all_known"))
        following = materialize(
            state.join(seen, "chunk_id").select("chunk_id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("some"), False).when(F.col("all_known"), True).alias("kept")),
            "state",
        )
        drop(state)
        state = following
        if not state.where("kept is null").limit(1).count():
            break
    return nodes.select("chunk_id").join(state, "chunk_id", "left").select("chunk_id", F.coalesce("kept", F.lit(True)).alias("kept"))


def near_duplicates(chunks: DataFrame, threshold: float = THRESHOLD, scope: str = "file", pairs: DataFrame | None = None) -> DataFrame:
    """chunk_id and status (kept, exact, near): what is kept in order of id, and the copies of what is kept.

    A copy of a chunk that went as a near duplicate is a near duplicate as well:
    only what is kept is compared with. ``pairs`` of first chunks may be given.
    """
    of = materialize(classes(chunks, scope), "classes")
    first = of.where("chunk_id = rep").select("chunk_id")
    kept = first_wins(first, similar_pairs(chunks, threshold, scope) if pairs is None else pairs).select(F.col("chunk_id").alias("rep"), "kept")
    status = F.when(~F.col("kept"), "near").when(F.col("chunk_id") == F.col("rep"), "kept").when(F.col("content_hash") == F.col("rep_hash"), "exact").otherwise("near")
    return of.join(kept, "rep").select("chunk_id", status.alias("status"))


def minhash_bands(chunks: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS, seed: int = 1) -> DataFrame:
    """(chunk_id, source, band, key): band hashes of the minimum of universal hashes over the word set."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 2**63, permutations, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, source, keys = batch.column("chunk_id"), batch.column("source"), []
            for h in batch.column("hashes").to_pylist():
                x = np.array(h, np.int64).view(np.uint64)
                low = np.full(permutations, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(x), 4096):
                    low = np.minimum(low, (x[at : at + 4096, None] * a + b).min(0))
                keys.append([int.from_bytes(_fold(r), "little", signed=True) for r in low.reshape(bands, -1)])
            n = len(keys)
            rep = pa.array(np.repeat(np.arange(n), bands))
            yield pa.RecordBatch.from_arrays(
                [ids.take(rep), source.take(rep), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array([k for r in keys for k in r], pa.int64())], ["chunk_id", "source", "band", "key"]
            )

    hashed = chunks.select("chunk_id", "source", F.transform(F.array_distinct(T.words(F.lower("content"))), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.where(F.size("hashes") > 0).mapInArrow(run, "chunk_id long, source string, band int, key long")


def _fold(row: np.ndarray) -> bytes:
    h = np.uint64(1469598103934665603)
    with np.errstate(over="ignore"):
        for x in row:
            h = (h ^ x) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
    return h.tobytes()


def minhash_pairs(chunks: DataFrame, threshold: float = THRESHOLD, scope: str = "file", verify: bool = True) -> DataFrame:
    """Candidate pairs (a < b) of the banded index over the first chunks of their word sets, verified by exact Jaccard unless told not to."""
    chunks = materialize(representatives(chunks, scope), "representatives")
    keys = materialize(minhash_bands(chunks), "bands")
    on = ["band", "key"] + (["source"] if scope == "file" else [])
    a, b = keys.withColumnRenamed("chunk_id", "a"), keys.withColumnRenamed("chunk_id", "b")
    if scope != "file":
        a, b = a.drop("source"), b.drop("source")
    pairs = a.join(b, on).where("a < b").select("a", "b").distinct()
    return _similar(chunks, pairs).where(F.col("jaccard") >= threshold).select("a", "b") if verify else pairs


def dedup_stats(status: DataFrame) -> DataFrame:
    one = status.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "exact").alias("exact_duplicates"), F.count_if(F.col("status") == "near").alias("near_duplicates"), F.count_if(F.col("status") == "kept").alias("kept"))
    return one.withColumn("ratio", F.round(F.try_divide(F.col("total") - F.col("kept"), F.col("total")), 6))
