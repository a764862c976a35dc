"""Top-k scans of vectors: query blocks against Arrow batches, exact or in the nearest cells of an index.

Queries come in blocks of ``BLOCK`` whose matrix is broadcast; a task scores its
batches by matrix products and keeps the k best of each query (and group), so
that what is shuffled doesn't grow with the points of a task. Scores are rounded
to 12 digits, which makes equal vectors tie; ties go to the smaller id. A vector
without a length, a null one and one of another dimension have no score (null).

An index puts points into k-means cells, which are learnt on a bounded sample;
every point is indexed. A query looks into its nearest cells only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.runtime import materialize

#: Queries of a block, points that are scored at once, cells of an index, points that its cells are learnt on.
BLOCK, ROWS, CELLS, SAMPLE = 1024, 4096, 100, 50_000
#: Share of the cells that a query looks into by default: vectors without clusters (as the test data's) need that much for a recall of 0.9.
PROBED = 0.75


def unit(vectors: pa.Array, size: int | None = None) -> np.ndarray:
    """Rows of unit length; NaN where there is none."""
    lists = vectors.to_pylist()
    size = size or max((len(x) for x in lists if x), default=1)
    out = np.full((len(lists), size), np.nan)
    for i, x in enumerate(lists):
        if x is not None and len(x) == size and None not in x:
            out[i] = x
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.full_like(out, np.nan), where=length > 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """As :func:`unit`, without a Python list where all rows are whole."""
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) != len(column) * size:
        return unit(column, size)
    out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.full_like(out, np.nan), where=length > 0)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by falling score (none last), then by id."""
    value = np.where(np.isnan(score), -np.inf, score)
    some = np.flatnonzero(value >= np.partition(value, len(value) - k)[len(value) - k]) if len(value) > k else np.arange(len(value))
    return some[np.lexsort((ids[some], -value[some]))][:k]


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of a bounded number of queries at a time."""
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    number = -(-q.count() // BLOCK)
    for k in range(number):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == k).toArrow().combine_chunks()
        if rows.num_rows:
            yield rows.column("query_id").to_pylist(), unit(rows.column("vector").combine_chunks())


def scan(queries: DataFrame, points: DataFrame, k: int, by: str | None = None, centres: np.ndarray | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, [by,] node_id, vector_score, rank): the k best points (node_id, vector) of each query, and of each group if asked.

    With ``centres``, points have a column ``cell``, and a query is compared with those of its nearest ``probes`` cells only.
    """
    if centres is not None and probes is None:
        probes = max(1, int(np.ceil(PROBED * len(centres))))
    spark = points.sparkSession
    of_type = {"query_id": queries.schema["query_id"].dataType, **{c: points.schema[c].dataType for c in (by, "node_id") if c}}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in of_type.items()) + ", vector_score double"
    arrow = [to_arrow_type(t) for t in of_type.values()]
    found = None
    for ids, matrix in _blocks(queries):
        near = None
        if centres is not None:
            near = np.zeros((len(ids), len(centres)), bool)
            near[np.arange(len(ids))[:, None], np.argsort(-np.nan_to_num(matrix @ centres.T), axis=1, kind="stable")[:, :probes]] = True
        shared = spark.sparkContext.broadcast((ids, matrix, near))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, near = shared.value
            held: dict = {}  # of each query and group: scores, ids
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    node = np.array(part.column("node_id").to_pylist())
                    score = np.round(matrix @ _matrix(part.column("vector"), matrix.shape[1]).T, 12)
                    cell = part.column("cell").to_numpy() if near is not None else None
                    group = np.array(part.column(by).to_pylist(), object) if by else None
                    for g in dict.fromkeys(group.tolist()) if by else (None,):
                        of = np.flatnonzero(group == g) if by else np.arange(len(node))
                        for q in range(len(ids)):
                            mine = of if near is None else of[near[q][cell[of]]]
                            if not len(mine):
                                continue
                            s, n = score[q, mine], node[mine]
                            if (q, g) in held:
                                s, n = np.append(held[q, g][0], s), np.append(held[q, g][1], n)
                            top = _best(s, n, k)
                            held[q, g] = s[top], n[top]
            for (q, g), (s, n) in held.items():
                cols = [[ids[q]] * len(n), *([[g] * len(n)] if by else []), n.tolist()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, arrow, strict=True)), pa.array(s, mask=np.isnan(s))], [*of_type, "vector_score"])

        columns = ["node_id", F.col("vector").cast("array<double>").alias("vector"), *([by] if by else []), *(["cell"] if centres is not None else [])]
        some = points.select(*columns).mapInArrow(run, schema)
        found = some if found is None else found.unionAll(some)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc_nulls_last("vector_score"), "node_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def centres(points: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Unit centres of spherical k-means on at most ``sample`` points, chosen by a hash of the id."""
    rows = points.where("vector is not null").select("node_id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("node_id"), "node_id").limit(sample).toArrow()
    x = unit(rows.column("vector").combine_chunks()) if rows.num_rows else np.zeros((0, 1))
    x = x[~np.isnan(x).any(1)]
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        of = np.concatenate([np.argmax(x[a : a + ROWS] @ c.T, axis=1) for a in range(0, len(x), ROWS)])
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        length = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.divide(total, length, out=c.copy(), where=length > 0)
    return c


def index(points: DataFrame, learnt: np.ndarray, path: str | None = None) -> DataFrame:
    """All points (without a column of that name) with their ``cell``; written by cell if a path is given, so that searches prune files."""
    shared = points.sparkSession.sparkContext.broadcast(learnt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.nan_to_num(_matrix(batch.column("vector"), shared.value.shape[1]))
            cell = np.concatenate([np.argmax(x[a : a + ROWS] @ shared.value.T, axis=1) for a in range(0, len(x), ROWS)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    out = points.mapInArrow(run, StructType([*points.schema.fields, StructField("cell", IntegerType())]))
    if path is None:
        return materialize(out, "cells")
    out.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return points.sparkSession.read.parquet(path)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Queries, and the share of the exact answers that were found."""
    hit = exact.select("query_id", "node_id").join(found.select("query_id", "node_id", F.lit(1).alias("hit")), ["query_id", "node_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
