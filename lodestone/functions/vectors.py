"""Column expressions over float arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the vectors has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


#: Size of a text's vector; words and texts that are summed up at once.
SIZE, WORDS, TEXTS = 384, 1 << 18, 1 << 10


def hashed_embedding(text: Column, size: int = SIZE) -> Column:
    """A deterministic stand-in for an encoder: signed hashes of all words summed by bucket, of unit length (zero without words).

    Where the signs of all words cancel out, the words are counted without signs.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _embed(size)(F.transform(words, lambda w: F.xxhash64(w)))


def _embed(size: int):
    @F.arrow_udf("array<float>")
    def embed(hashes: pa.Array) -> pa.Array:
        n = pc.list_value_length(hashes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, h = np.append(0, np.cumsum(n)), hashes.flatten().to_numpy()
        out = np.zeros((len(n), size), np.float32)
        at = 0
        while at < len(n):
            # a longer text stands alone
            to = min(at + TEXTS, max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS, "right")) - 1))
            some, shape = h[ends[at] : ends[to]], (to - at, size)
            place = np.repeat(np.arange(to - at) * size, n[at:to]) + (some >> 1) % size
            v = np.bincount(place, np.where(some & 1, 1.0, -1.0), (to - at) * size).reshape(shape)
            gone = ~v.any(1)
            if n[at:to][gone].any():
                v[gone] = np.bincount(place, minlength=(to - at) * size).reshape(shape)[gone]
            length = np.sqrt((v * v).sum(1, keepdims=True))
            np.divide(v, length, out=out[at:to], where=length > 0)
            at = to
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), pa.array(out.reshape(-1)))

    return embed
