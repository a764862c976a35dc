"""Retrieval: hierarchy filters, exact vector search, text and file search, graph enrichment, fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestone.functions.strings import Strings
from lodestone.operators.vectorscan import scan
from lodestone.runtime import materialize, maybe_broadcast

#: Difficulty by level name, fusion and enrichment weights, phrases that ask for a summary.
LEVELS = {"foundation": 1, "intermediate": 2, "advanced": 3, "research": 4, "frontier": 5}
WEIGHTS = (0.5, 0.3, 0.2)
SUMMARY = [
    "summarize", "summary", "overview", "what is this file", "what is the document", "what is this pdf", "describe the content",
    "about the content", "main points", "key takeaways", "what's inside", "what is inside",
]
CANDIDATES = 20
#: Text queries that are broadcast at once; strings that are looked for at once; bytes of text in which they are.
QUERIES, STRINGS, SLICE = 1000, 20_000, 2 << 20


def contains_all(path: Column, wanted: list[str]) -> Column:
    """Set containment, whatever the order."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), path)) == 0 if wanted else F.lit(True)


def by_hierarchy(nodes: DataFrame, gate_id: int, branch_id: int | None = None, prefix: list[str] | None = None, depth: tuple[int, int] = (1, 7), difficulty: int = 5, limit: int = 10) -> DataFrame:
    """Nodes of a gate within depth and difficulty; best quality first (unknown before all), then depth."""
    rows = nodes.where((F.col("gate_id") == gate_id) & F.col("depth").between(*depth) & (F.col("difficulty_id") <= difficulty))
    if branch_id:
        rows = rows.where(F.col("branch_id") == branch_id)
    if prefix:
        rows = rows.where(contains_all(F.col("path"), prefix))
    return rows.orderBy(F.desc_nulls_first("quality"), "depth", "node_id").limit(limit)


def vector_search(queries: DataFrame, points: DataFrame, k: int = CANDIDATES, gate_id: int | None = None, node_type: str | None = None, difficulty: int = 5, depth: tuple[int, int] = (1, 7)) -> DataFrame:
    """(query_id, node_id, vector_score, rank): exact cosine top-k of each query after filters.

    Any number of queries, in blocks; the points stay where they are and each
    partition sends k rows a query at most.
    """
    p = points
    if gate_id:
        p = p.where(F.col("gate_id") == gate_id)
    if node_type:
        p = p.where(F.col("node_type") == node_type)
    if difficulty < 5:
        p = p.where(F.col("difficulty_id") <= difficulty)
    if depth[0] > 1:
        p = p.where(F.col("depth") >= depth[0])
    return scan(queries, p, k)


def prerequisites(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(start, node_id, depth): nodes that REQUIRES edges lead to, at their least depth. Cycles end at visited nodes."""
    step = edges.where("edge_type = 'REQUIRES'").select(F.col("from_node").alias("at"), F.col("to_node").alias("node_id"))
    level = start.select(F.col("node_id").alias("start"), F.col("node_id").alias("at")).distinct()
    found = None
    for d in range(1, depth + 1):
        level = level.join(step, "at").select("start", F.col("node_id").alias("at")).distinct()
        rows = level.select("start", F.col("at").alias("node_id"), F.lit(d).alias("depth"))
        found = rows if found is None else found.unionAll(rows)
    return found.where("start <> node_id").groupBy("start", "node_id").agg(F.min("depth").alias("depth"))


def linked(nodes: DataFrame, edges: DataFrame, edge_type: str, node_type: str) -> DataFrame:
    """(to_node, node_id, weight): nodes of a type with such an edge to a node; no or zero weight counts as 1."""
    e = edges.where(F.col("edge_type") == edge_type).select("from_node", "to_node", "weight")
    n = nodes.where(F.col("node_type") == node_type).select(F.col("node_id").alias("from_node"))
    return e.join(n, "from_node").select("to_node", F.col("from_node").alias("node_id"), F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")).alias("weight"))


def examples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return linked(nodes, edges, "EXAMPLE_OF", "PROBLEM")


def ranked_examples(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` examples of each node with the largest weight, smaller ids first among equals."""
    rank = F.row_number().over(Window.partitionBy("to_node").orderBy(F.desc("weight"), "node_id"))
    return examples(nodes, edges).withColumn("rank", rank).where(F.col("rank") <= k)


def verifiers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return linked(nodes, edges, "VERIFIES", "SKILL")


def enrich(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Candidates with counts of prerequisites, examples and verifiers, and the graph score.

    The candidates are few (a rank-limited set), so edges are first reduced to
    those that touch them.
    """
    ids = candidates.select("node_id").distinct()
    p = prerequisites(edges, ids, depth).groupBy(F.col("start").alias("node_id")).agg(F.count("*").alias("p"))
    kind = nodes.select("node_id", "node_type", "quality")
    near = edges.join(ids.withColumnRenamed("node_id", "to_node"), "to_node", "left_semi")
    e = examples(nodes, near).groupBy(F.col("to_node").alias("node_id")).agg(F.count("*").alias("e"))
    v = verifiers(nodes, near).groupBy(F.col("to_node").alias("node_id")).agg(F.count("*").alias("v"))
    out = candidates.join(kind, "node_id").join(p, "node_id", "left").join(e, "node_id", "left").join(v, "node_id", "left")
    out = out.withColumns({"p": F.coalesce("p", F.lit(0)), "e": F.when(F.col("node_type").isin("CONCEPT", "FORMULA"), F.coalesce("e", F.lit(0))).otherwise(0), "v": F.coalesce("v", F.lit(0))})
    part = lambda c, n: F.least(F.col(c) / n, F.lit(1.0))
    return out.withColumn("graph_score", F.lit(0.4) * part("p", 3) + F.lit(0.3) * part("e", 2) + F.lit(0.3) * part("v", 1))


def fuse(enriched: DataFrame, k: int, weights: tuple[float, float, float] = WEIGHTS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted sum of vector, graph and quality scores; the k best of each query, earlier candidates first among equals."""
    v, g, q = weights
    quality = F.when(F.coalesce("quality", F.lit(0.0)) == 0, 0.5).otherwise(F.col("quality"))
    score = F.lit(v) * F.coalesce("vector_score", F.lit(0.0)) + F.lit(g) * F.coalesce("graph_score", F.lit(0.0)) + F.lit(q) * quality
    w = Window.partitionBy(*by).orderBy(F.desc("combined"), "rank")
    return enriched.withColumn("combined", score).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def hybrid(queries: DataFrame, points: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10, level: str = "intermediate", gate_id: int | None = None, texts: DataFrame | None = None, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Vector candidates (text candidates for queries without a vector), graph enrichment, fusion.

    Candidates are written once, as three joins read them.
    """
    found = vector_search(queries.where("vector is not null"), points, CANDIDATES, gate_id, difficulty=LEVELS.get(level, 2))
    if texts is not None:
        found = found.unionByName(text_fallback(queries.where("vector is null"), texts, CANDIDATES, gate_id))
    return fuse(enrich(materialize(found, "candidates"), nodes, edges), k, weights)


def ilike(text: Column, query: Column, literal: bool = False) -> Column:
    """Case-insensitive containment; % and _ of the query are wildcards unless literal."""
    return F.contains(F.lower(text), F.lower(query)) if literal else F.call_function("ilike", text, F.concat(F.lit("%"), query, F.lit("%")))


def query_blocks(queries: DataFrame, most: int = QUERIES) -> Iterator[DataFrame]:
    """At most about ``most`` queries at a time, to be broadcast."""
    number = max(1, -(-queries.count() // most))
    for k in range(number):
        yield F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == k) if number > 1 else queries)


def text_fallback(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES, gate_id: int | None = None, literal: bool = False) -> DataFrame:
    """(query_id, node_id, vector_score, rank): chunks that contain the query, best quality first, with a fixed score.

    Queries without wildcards are looked for all at once where the texts are;
    others are compared one by one. Only hits are shuffled, of the former k of
    a task and query at most. Null or empty queries find nothing.
    """
    c = (chunks if gate_id is None else chunks.where(F.col("gate_id") == gate_id)).select("node_id", "quality", "content")
    asked = materialize(queries.select("query_id", F.col("text").alias("query"), F.lower("text").alias("string")).where("query <> ''"), "asked")
    plain = F.lit(True) if literal else ~F.col("query").rlike(r"[%_\\\\]")
    found = _strings_found(asked.where(plain), c, k)
    if not literal and asked.where(~plain).limit(1).count():
        for q in query_blocks(asked.where(~plain)):
            found = found.unionAll(c.join(q, ilike(F.col("content"), F.col("query"))).select("query_id", "node_id", "quality"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("quality"), "node_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "node_id", F.lit(0.5).alias("vector_score"), "rank")


def _strings_found(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, quality): texts that contain the lower-cased string of a query, the k best of each task at least."""
    spark = chunks.sparkSession
    kinds = [chunks.schema[c].dataType for c in ("node_id", "quality")]
    arrow = [to_arrow_type(t) for t in kinds]
    schema = f"string string, node_id {kinds[0].simpleString()}, quality {kinds[1].simpleString()}"
    low = chunks.select("node_id", "quality", F.lower("content").alias("content")).where("content is not null")
    strings = asked.select("string").distinct()
    number = -(-strings.count() // STRINGS)
    hits = spark.createDataFrame([], schema)
    for part in range(number):
        some = sorted(r.string for r in strings.where(F.pmod(F.xxhash64("string"), F.lit(number)) == part).collect())  # a bounded number
        shared = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, held = Strings(shared.value), None
            for batch in batches:
                for table in index.slices(batch, "content", SLICE):
                    row, which = index.find(table.column("content"))
                    new = pa.table({"which": pa.array(which), "node_id": table.column("node_id").take(pa.array(row)), "quality": table.column("quality").take(pa.array(row))})
                    held = best(new if held is None else pa.concat_tables([held, new]), k)
            if held is not None:
                for out in held.combine_chunks().to_batches():
                    names = pa.array(shared.value, pa.string()).take(out.column("which"))
                    yield pa.RecordBatch.from_arrays([names, *(out.column(c).cast(t) for c, t in zip(("node_id", "quality"), arrow, strict=True))], ["string", "node_id", "quality"])

        hits = hits.unionAll(low.mapInArrow(run, schema))
    return asked.select("query_id", "string").join(hits, "string").select("query_id", "node_id", "quality")


def best(hits: pa.Table, k: int) -> pa.Table:
    """The k best rows of each value of ``which``: by falling quality (none last), then by id; null ids come first."""
    quality, node = hits.column("quality"), hits.column("node_id")
    # NaN is above all numbers, as in Spark
    nan = pc.is_nan(quality).fill_null(False) if pa.types.is_floating(quality.type) else pa.array([False] * len(hits))
    keys = pa.table({"which": hits.column("which"), "none": quality.is_null(), "nan": pc.cast(nan, pa.int8()), "quality": quality, "known": node.is_valid(), "node": node})
    order = [("which", "ascending"), ("none", "ascending"), ("nan", "descending"), ("quality", "descending"), ("known", "ascending"), ("node", "ascending")]
    hits = hits.take(pc.sort_indices(keys, order))
    which = hits.column("which").to_numpy()
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1])[: len(which)])
    place = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
    return hits.filter(pa.array(place < k))


def wants_summary(query: str) -> bool:
    return any(p in query.lower() for p in SUMMARY)


def file_search(query: str, files: DataFrame, file_chunks: DataFrame, session_id: int | None = None, limit: int = 10, literal: bool = False) -> DataFrame:
    """Chunks of uploaded files: the beginning of the newest file for a summary, else those that contain the query."""
    f = files if session_id is None else files.where(F.col("session_id") == session_id)
    if wants_summary(query) and session_id is not None:
        newest = f.groupBy().agg(F.max_by("file_id", F.struct("uploaded_at", "file_id")).alias("file_id"))
        rows = file_chunks.join(F.broadcast(newest), "file_id").orderBy("chunk_index").limit(5)
        return rows.select("chunk_id", "file_id", "chunk_index", F.lit(1.0).alias("score"))
    q = F.lit(query)
    hit, context = ilike(F.col("content"), q, literal), ilike(F.col("contextual_content"), q, literal)
    rows = file_chunks.where(hit | context).join(f.select("file_id"), "file_id")
    score = F.when(hit, 2.0).when(context, 1.5).otherwise(1.0)
    return rows.withColumn("score", score).orderBy(F.desc("score"), "chunk_index", "chunk_id").limit(limit).select("chunk_id", "file_id", "chunk_index", "score")


def file_hits(queries: DataFrame, files: DataFrame, file_chunks: DataFrame, k: int = 10, literal: bool = False) -> DataFrame:
    """:func:`file_search` for many (query_id, text, session_id): (query_id, chunk_id, file_id, chunk_index, score, position)."""
    q = queries.where("session_id is not null and text <> ''").select("query_id", "text", "session_id")
    summary = F.lit(False)
    for p in SUMMARY:
        summary = summary | F.contains(F.lower("text"), F.lit(p))
    q = q.withColumn("summary", summary)
    f = files.select("file_id", "session_id", "uploaded_at")
    newest = f.groupBy("session_id").agg(F.max_by("file_id", F.struct("uploaded_at", "file_id")).alias("file_id"))
    chunk = file_chunks.select("chunk_id", "file_id", "chunk_index", "content", "contextual_content")
    whole = q.where("summary").join(newest, "session_id").join(chunk, "file_id").select("query_id", "chunk_id", "file_id", "chunk_index", F.lit(1.0).alias("score"), F.lit(5).alias("most"))
    rows = q.where("not summary").join(f, "session_id").join(chunk, "file_id")
    hit, context = ilike(F.col("content"), F.col("text"), literal), ilike(F.col("contextual_content"), F.col("text"), literal)
    found = rows.where(hit | context).select("query_id", "chunk_id", "file_id", "chunk_index", F.when(hit, 2.0).otherwise(1.5).alias("score"), F.lit(k).alias("most"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_index", "chunk_id"))
    return whole.unionByName(found).withColumn("position", position).where(F.col("position") <= F.least("most", F.lit(k))).drop("most")


def combine(file_hits: DataFrame, hits: DataFrame, k: int, merge: bool = False) -> DataFrame:
    """(query_id, kind, id, score, position) of hits (query_id, id, score, position): those in files alone where
    they fill k or nothing else was found; they are dropped otherwise, or put first if merged."""
    counts = file_hits.groupBy("query_id").agg(F.count("*").alias("in_files")).join(hits.groupBy("query_id").agg(F.count("*").alias("others")), "query_id", "full")
    alone = (F.col("in_files") >= k) | F.col("others").isNull()
    side = lambda df, kind: df.select("query_id", F.lit(kind).alias("kind"), "id", "score", "position")
    # a count of each query: the sets are rank-limited, so this is small beside what was searched
    files = side(file_hits, "file").join(counts, "query_id").where(alone | F.lit(merge)).drop("in_files", "others")
    rest = side(hits, "node").join(counts, "query_id").where(~F.coalesce(alone, F.lit(False)))
    if merge:
        rest = rest.withColumn("position", F.col("position") + F.coalesce("in_files", F.lit(0)))
    return files.unionByName(rest.drop("in_files", "others")).where(F.col("position") <= k)


def hybrid_retrieve(queries: DataFrame, points: DataFrame, nodes: DataFrame, edges: DataFrame, texts: DataFrame, files: DataFrame, file_chunks: DataFrame, k: int = 10, level: str = "intermediate", merge: bool = False) -> DataFrame:
    """(query_id, kind, id, score, position): the whole of retrieval for many (query_id, vector, text, session_id).

    Hits in the session's files come first and may be enough; else vector
    candidates (text candidates without a vector), graph enrichment, fusion.
    """
    in_files = file_hits(queries, files, file_chunks, k).select("query_id", F.col("chunk_id").alias("id"), "score", "position")
    in_files = materialize(in_files, "file-hits")
    ranked = hybrid(queries, points, nodes, edges, k, level, texts=texts)
    return combine(in_files, ranked.select("query_id", F.col("node_id").alias("id"), F.col("combined").alias("score"), "position"), k, merge)


def multi_gate(points: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, gate_ids: list[int] | None = None, k: int = 5, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """The k best of each query in each gate (all gates without a list): one scan and one ranking for all."""
    some = points if gate_ids is None else points.where(F.col("gate_id").isin(gate_ids))
    found = materialize(scan(queries, some, CANDIDATES, by="gate_id"), "candidates")
    return fuse(enrich(found, nodes, edges), k, weights, by=("query_id", "gate_id"))


def bm25(queries: DataFrame, words: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score, position) over an occurrence table (chunk_id, word)."""
    size = words.groupBy("chunk_id").agg(F.count("*").alias("n"))
    stats = size.agg(F.count("*").alias("chunks"), F.avg("n").alias("mean"))
    queries = materialize(queries, "words")
    wanted = maybe_broadcast(queries.select("word").distinct())
    tf = words.join(wanted, "word").groupBy("chunk_id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    rows = tf.join(df, "word").join(maybe_broadcast(queries), "word").join(size, "chunk_id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("position", position).where(F.col("position") <= k)


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 20) -> DataFrame:
    """Mean NDCG, precision, recall and reciprocal rank at k. ranked: (query_id, node_id, rank); relevant: (query_id, node_id)."""
    total = relevant.groupBy("query_id").agg(F.count("*").alias("r"))
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "node_id"])
    gain = lambda c: 1 / F.log2(c + 1)
    per = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum(gain(F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("r"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i))
    per = total.join(per, "query_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "ndcg": F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), "rr": F.coalesce(1 / F.col("first"), F.lit(0.0))})
    return per.agg(
        F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg(F.col("hits") / k), 6).alias("precision"), F.round(F.avg(F.col("hits") / F.col("r")), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr")
    )


def search_reduction(nodes: DataFrame, gate_id: int, branch_id: int, difficulty: int) -> DataFrame:
    """How many nodes are left after each level of the address."""
    g = F.col("gate_id") == gate_id
    b = g & (F.col("branch_id") == branch_id)
    d = b & (F.col("difficulty_id") <= difficulty)
    return nodes.agg(F.count("*").alias("total"), F.count_if(g).alias("gate"), F.count_if(b).alias("branch"), F.count_if(d).alias("level"))


def by_names(nodes: DataFrame, gates: DataFrame, gate: str, path: list[str] | None = None, level: str | None = None) -> DataFrame:
    """Nodes of a gate given by name (gates: gate_id, gate), of a path and up to a level."""
    rows = nodes.join(F.broadcast(gates.where(F.col("gate") == gate)), "gate_id")  # one row by its name
    if path:
        rows = rows.where(contains_all(F.col("path"), path))
    return rows.where(F.col("difficulty_id") <= LEVELS[level]) if level else rows
