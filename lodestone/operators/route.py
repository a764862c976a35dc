"""Labelling of chunks and routing of queries to gates."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import gates as G
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators.retrieve import LEVELS
from lodestone.runtime import maybe_broadcast, running_total

#: Fixed values of the routing rules.
SKIP = [r"^(hi|hello|hey|thanks|thank you)", r"^(yes|no|okay|ok|sure)", r"^what is"]
FORCE = [r"how to|how do i", r"why|explain", r"debug|error|issue|problem"]
COMPLEX = ["how", "why", "debug", "error", "implement", "integrate", "optimize", "configure", "troubleshoot", "explain"]
SIMPLE_WORDS, GRAPH_COMPLEXITY = 5, 3


def keyword_gate(chunks: DataFrame, gates: dict[str, list[str]] = G.CHUNK_GATES, default: str = G.DEFAULT_CHUNK_GATE) -> DataFrame:
    """chunk_id, gate, score: the gate with most keywords in the text, the first declared of equals.

    The gate table is a handful of rows, so it is folded into one expression per
    row: no join and no shuffle.
    """
    scores = [F.struct(T.hits(F.col("content"), k).alias("score"), F.lit(-i).alias("order"), F.lit(g).alias("gate")) for i, (g, k) in enumerate(gates.items())]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return chunks.select("chunk_id", best.alias("b")).select("chunk_id", F.when(F.col("b.score") > 0, F.col("b.gate")).otherwise(default).alias("gate"), F.coalesce("b.score", F.lit(0)).alias("score"))


def skip_vector(query: Column) -> Column:
    """Whether a query needs no vector search: greetings and definitions, or a few plain words."""
    low = T.strip(F.lower(query))
    skip, force = F.lit(False), F.lit(False)
    for p in SKIP:
        skip = skip | low.rlike(p)
    for p in FORCE:
        force = force | low.rlike(p)
    return F.when(skip, True).when(force, False).otherwise(F.size(T.words(query)) <= SIMPLE_WORDS)


def complexity(query: Column) -> Column:
    """1 to 10 by length, question marks and procedural words."""
    n, marks = F.size(T.words(query)), T.str_count(query, "?")
    return F.least(
        F.lit(10),
        F.lit(1)
        + F.when(n > 20, 3).when(n > 10, 2).when(n > 5, 1).otherwise(0)
        + F.when(marks > 1, 2).when(marks == 1, 1).otherwise(0)
        + F.least(T.hits(query, COMPLEX), F.lit(3)),
    )


def gate_scores(query: Column, gates: dict[str, list[str]]) -> Column:
    """Gates with a hit, best first (the first declared of equals): array of (gate, score)."""
    parts = []
    for i, (g, k) in enumerate(gates.items()):
        m = T.hits(query, k)
        parts.append(F.struct((-F.least(m / len(k) + m * F.lit(0.1), F.lit(1.0))).alias("negative"), F.lit(i).alias("order"), F.lit(g).alias("gate"), m.alias("m")))
    return F.transform(F.sort_array(F.filter(F.array(*parts), lambda x: x["m"] > 0)), lambda x: F.struct(x["gate"].alias("gate"), (-x["negative"]).alias("score")))


def inverse_frequencies(gates: dict[str, list[str]]) -> dict[str, float]:
    """Of each keyword, the logarithm of one plus gates over gates that have it."""
    return {k: math.log(1 + len(gates) / sum(k in words for words in gates.values())) for words in gates.values() for k in words}


def tfidf_gate(queries: DataFrame, gates: dict[str, list[str]], default: str = G.DEFAULT_QUERY_GATE) -> DataFrame:
    """(query_id, gate, score): the gate with the largest share of its keywords' weight in the text, the first declared of equals."""
    weight = inverse_frequencies(gates)

    def scored(low: Column) -> Column:
        share = lambda words: T.total([F.when(F.contains(low, F.lit(k)), weight[k]).otherwise(0.0) for k in words]) / F.lit(sum(weight[k] for k in words))
        return F.greatest(*(F.struct(F.round(share(words), 6).alias("score"), F.lit(-i).alias("order"), F.lit(g).alias("gate")) for i, (g, words) in enumerate(gates.items())))

    best = queries.select("query_id", T.bound(F.lower("text"), scored).alias("b"))
    return best.select("query_id", F.when(F.col("b.score") > 0, F.col("b.gate")).otherwise(default).alias("gate"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def route(queries: DataFrame, gates: dict[str, list[str]], predictions: DataFrame | None = None, default: str = G.DEFAULT_QUERY_GATE, optimise: bool = True, accept: float = 0.6) -> DataFrame:
    """Routing decision of each (query_id, text): a confident prediction, else keywords, else the default gate.

    ``predictions``: optional (query_id, predicted, predicted_confidence).
    """
    q = queries.withColumn("scores", gate_scores(F.col("text"), gates))
    fallback = default if default in gates else next(iter(gates))
    use = F.lit(False)
    if predictions is not None:
        q = q.join(predictions, "query_id", "left")
        use = F.coalesce(F.col("predicted_confidence") > accept, F.lit(False))
    else:
        q = q.withColumns({"predicted": F.lit(None).cast("string"), "predicted_confidence": F.lit(None).cast("double")})
    first = F.get("scores", F.lit(0))
    found = F.size("scores") > 0
    return q.select(
        "query_id",
        F.when(use, F.col("predicted")).when(found, first["gate"]).otherwise(fallback).alias("gate"),
        F.when(use, F.col("predicted_confidence")).when(found, first["score"]).otherwise(F.lit(0.3)).alias("confidence"),
        F.when(use, F.array().cast("array<string>")).otherwise(F.slice(F.transform(F.filter(F.slice("scores", 2, 1000), lambda s: s["score"] > 0.3), lambda s: s["gate"]), 1, 2)).alias("secondary"),
        F.when(use, "model").when(found, "keyword").otherwise("default").alias("method"),
        (skip_vector(F.col("text")) if optimise else F.lit(False)).alias("skip_vector"),
        (complexity(F.col("text")) >= GRAPH_COMPLEXITY if optimise else F.lit(True)).alias("use_graph"),
    )


def centroids(points: DataFrame, per_gate: int | None = None) -> DataFrame:
    """(gate_id, centroid): mean vector of each gate, of its first ``per_gate`` points if given."""
    p = points
    if per_gate:
        p = p.withColumn("rank", F.row_number().over(Window.partitionBy("gate_id").orderBy("node_id"))).where(F.col("rank") <= per_gate)
    mean = p.select("gate_id", F.posexplode(V.doubles(F.col("vector"))).alias("at", "x")).groupBy("gate_id", "at").agg(F.avg("x").alias("x"))
    return mean.groupBy("gate_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))


def centroid_route(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(node_id, gate_id, similarity, probability, rank) of each point against all gates: softmax of cosines.

    There is a centre per gate, a bounded number; they are broadcast.
    """
    scored = points.select("node_id", "vector").crossJoin(F.broadcast(centres)).select("node_id", "gate_id", V.cosine(F.col("vector"), F.col("centroid")).alias("similarity"))
    w = Window.partitionBy("node_id")
    e = F.exp(F.col("similarity") - F.max("similarity").over(w))
    return scored.withColumn("e", e).select(
        "node_id", "gate_id", "similarity", (F.col("e") / F.sum("e").over(w)).alias("probability"), F.row_number().over(w.orderBy(F.desc("similarity"), "gate_id")).alias("rank")
    )


def multi_gate(scored: DataFrame, least: float = 0.15) -> DataFrame:
    """Gates of at least that probability, with their position by falling probability."""
    position = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("probability"), "gate_id"))
    return scored.where(F.col("probability") >= least).withColumn("position", position)


def secondary_gates(scored: DataFrame, most: int = 3, above: float = 0.1) -> DataFrame:
    """(node_id, secondary): of the ``most`` likeliest gates those beside the best, above a probability, in order."""
    some = scored.where((F.col("rank") > 1) & (F.col("rank") <= most) & (F.col("probability") > above))
    found = some.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gate_id"))), lambda x: x["gate_id"]).alias("secondary"))
    return scored.select("node_id").distinct().join(found, "node_id", "left").select("node_id", F.coalesce("secondary", F.array().cast("array<int>")).alias("secondary"))


def route_in_stages(queries: DataFrame, predictions: DataFrame, keywords: DataFrame, semantic: DataFrame, accept: tuple[float, float] = (0.7, 0.6)) -> DataFrame:
    """(node_id, gate_id, confidence, method, fallback_chain) of each query: the classifier where it is confident
    enough, else the keywords where they are, else the likeliest gate by similarity.

    predictions, keywords: (node_id, gate_id, confidence); semantic: as :func:`centroid_route`.
    """
    side = lambda df, n: df.select("node_id", F.col("gate_id").alias(f"g{n}"), F.col("confidence").alias(f"c{n}"))
    best = semantic.where("rank = 1").select("node_id", "gate_id", F.col("probability").alias("confidence"))
    rows = queries.select("node_id")
    for n, df in enumerate((predictions, keywords, best)):
        rows = rows.join(side(df, n), "node_id", "left")
    ok = [F.coalesce(F.col(f"c{n}") >= accept[n], F.lit(False)) for n in (0, 1)]
    pick = lambda x: F.when(ok[0], F.col(f"{x}0")).when(ok[1], F.col(f"{x}1")).otherwise(F.col(f"{x}2"))
    stages = ("model", "keyword", "semantic")
    tried = lambda n: F.array(*map(F.lit, stages[:n]))
    return rows.select(
        "node_id",
        pick("g").alias("gate_id"),
        pick("c").alias("confidence"),
        F.when(ok[0], stages[0]).when(ok[1], stages[1]).otherwise(stages[2]).alias("method"),
        F.when(ok[0], tried(1)).when(ok[1], tried(2)).otherwise(tried(3)).alias("fallback_chain"),
    )


def taxonomy_id(chunks: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Chunks with the id of their gate in a taxonomy (gate, gate_id); 0 for a gate that isn't there."""
    ids = taxonomy.groupBy("gate").agg(F.min("gate_id").alias("gate_id"))
    return chunks.join(maybe_broadcast(ids), "gate", "left").withColumn("gate_id", F.coalesce("gate_id", F.lit(0)))


def assemble_labels(chunks: DataFrame, labels: DataFrame, traits: dict[str, Column]) -> DataFrame:
    """Chunks with their label, its status, and the personality that their text shows; chunks without a valid label go."""
    return chunks.join(label_status(labels), "chunk_id").withColumn("personality", F.struct(*traits.values()))


def label_report(chunks: DataFrame, labels: DataFrame, size: int = 10) -> DataFrame:
    """Chunks, calls of the model (one for up to ``size`` chunks), valid labels and their share, by gate and over all (null)."""
    done = label_status(labels).select("chunk_id", F.lit(1).alias("done"))
    by = chunks.join(done, "chunk_id", "left").groupBy("gate").agg(F.count("*").alias("chunks"), F.ceil(F.count("*") / size).alias("api_calls"), F.count("done").alias("labelled"))
    one = by.agg(F.lit(None).cast("string").alias("gate"), *(F.sum(c).alias(c) for c in ("chunks", "api_calls", "labelled")))
    return by.unionByName(one).withColumn("success_rate", F.round(F.try_divide("labelled", "chunks"), 6))


def label_status(labels: DataFrame, drop_below: float = 0.7, approve_above: float = 0.8) -> DataFrame:
    """Valid labels of enough confidence, with their status."""
    ok = (
        F.col("gate").isNotNull()
        & (F.size("path") == F.size("path_ids"))
        & (F.size("path") == F.col("depth"))
        & F.col("depth").between(1, 7)
        & F.col("level").isin(list(LEVELS))
    )
    return labels.where(F.coalesce(ok, F.lit(False)) & (F.col("confidence") >= drop_below)).withColumn("status", F.when(F.col("confidence") > approve_above, "approved").otherwise("flagged"))


def format_taxonomy(tree: list[dict], most: int = 5, depth: int = 3, lines: int = 100) -> str:
    """Indented outline of a taxonomy: at most ``most`` entries a level, ``depth`` levels, ``lines`` lines."""
    out: list[str] = []

    def walk(nodes: list[dict], level: int) -> None:
        if level >= depth:
            return
        for n in nodes[:most]:
            out.append(f"{'  ' * level}- {n['name']} (id {n['id']})")
            walk(n.get("sublayers", []), level + 1)

    walk(tree, 0)
    return "\n".join(out[:lines])


def assign_batches(chunks: DataFrame, workers: int, size: int = 10) -> DataFrame:
    """Batch and worker of each chunk: batches of ``size`` by gate in order of id, dealt in turn."""
    rows = running_total(chunks, "gate", "chunk_id", F.lit(1), "n")
    return rows.withColumn("batch", F.floor(F.col("n") / size).cast("int")).withColumn("worker", F.col("batch") % workers).drop("n")


def classify(chunks: DataFrame, ask: Callable[[str, list[str]], str], size: int = 10) -> DataFrame:
    """(chunk_id, answer): labels of a text model, asked for up to ``size`` chunks of one gate at a time.

    ``ask(gate, texts)`` answers with a JSON list of objects that have ``n``, the
    text's place in the question; answers are matched by it, others are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for gate, group in frame.groupby("gate", sort=True):
                for at in range(0, len(group), size):
                    part = group.iloc[at : at + size]
                    reply = ask(gate, [c[:500] for c in part["content"]])
                    found = re.search(r"\[.*\]", reply, re.S)
                    try:
                        answers = json.loads(found[0]) if found else []
                    except ValueError:
                        answers = []
                    for a in answers:
                        if isinstance(a, dict) and isinstance(a.get("n"), int) and 0 <= a["n"] < len(part):
                            out.append((int(part["chunk_id"].iloc[a["n"]]), json.dumps(a)))
            yield pd.DataFrame(out, columns=["chunk_id", "answer"])

    return chunks.select("chunk_id", "gate", "content").mapInPandas(run, "chunk_id long, answer string")


def cached_centroids(points: DataFrame, path: str, per_gate: int | None = None) -> DataFrame:
    """Centroids from the table at ``path``, which is made if it isn't there."""
    spark = points.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        centroids(points, per_gate).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def gate_lookup(gates: DataFrame, name: str | None = None, gate_id: int | None = None) -> DataFrame:
    """The gates of a name, of an id, or all."""
    if name is not None:
        return gates.where(F.col("gate") == name)
    return gates if gate_id is None else gates.where(F.col("ordinal") == gate_id)


def gate_model(gates: DataFrame, name: str) -> DataFrame:
    """Model and provider of a gate."""
    return gates.where(F.col("name") == name).select("specialist_model", "provider")
