"""Reports over chunks, labels and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gate_distribution(nodes: DataFrame) -> DataFrame:
    by = nodes.groupBy("gate_id").agg(F.count("*").alias("n"), F.avg("quality").alias("q"))
    # one row per gate is left; the total is taken over those
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("gate_id", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"), F.round("q", 6).alias("avg_quality"))


def gate_volume(chunks: DataFrame) -> DataFrame:
    """Chunks and MB per source, and over all (null)."""
    return chunks.rollup("source").agg(F.count("*").alias("n"), F.round(F.sum(F.octet_length("content")) / 1048576.0, 6).alias("mb"))


def quality_histogram(scored: DataFrame) -> DataFrame:
    """Shares of ranges, mean and median; the median comes from counts by value (to six digits), of which there are a million at most."""
    q = F.col("quality")
    counts = scored.where(q.isNotNull()).groupBy(F.round(q, 6).alias("q")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("q"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    # the value, or the two values, in the middle
    middle = upto.where((F.col("upto") - F.col("n") <= F.floor(F.col("all") / 2)) & (F.col("upto") > F.floor((F.col("all") - 1) / 2)))
    median = middle.agg(F.round((F.min("q") + F.max("q")) / 2, 6).alias("median"))
    one = scored.agg(
        *(F.count_if((q >= a) & (q < b)).alias(f"q{int(a * 10)}") for a, b in ((0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.01))),
        F.round(F.avg(q), 6).alias("mean"),
        F.round(F.try_divide(F.count_if(q > 0.7), F.count(q)), 6).alias("above_07"),
        F.round(F.try_divide(F.count(q), F.count("*")), 6).alias("complete"),
    )
    return one.crossJoin(F.broadcast(median))  # one row each


def composite_quality(completeness: Column, readability: Column, informativeness: Column, structure: Column) -> Column:
    """Weighted sum of supplied components."""
    return F.round(F.lit(0.4) * completeness + F.lit(0.3) * readability + F.lit(0.2) * informativeness + F.lit(0.1) * structure, 6)


def graph_counters(chunks: DataFrame, entities: DataFrame, triplets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks seen and with entities, entities and triplets found, nodes and edges kept: one row."""
    with_some = entities.agg(F.countDistinct("chunk_id").alias("with_entities"), F.count("*").alias("entities"))
    out = chunks.agg(F.count("*").alias("chunks")).crossJoin(F.broadcast(with_some))
    for df, name in ((triplets, "triplets"), (nodes, "nodes"), (edges, "edges")):
        out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
    return out


def entity_types(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("key").alias("entities"), F.round(F.avg("score"), 6).alias("avg_score"))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations per entity and the share of entities with one."""
    ends = edges.select(F.col("subject").alias("name")).unionAll(edges.select("object")).distinct()
    n = nodes.join(ends.withColumn("linked", F.lit(1)), "name", "left").agg(F.count("*").alias("entities"), F.count("linked").alias("linked"))
    r = edges.agg(F.count("*").alias("relations"))
    return n.crossJoin(F.broadcast(r)).select("entities", "relations", F.round(F.try_divide("relations", "entities"), 6).alias("per_entity"), F.round(F.try_divide("linked", "entities"), 6).alias("connected"))


def mean_personality(chunks: DataFrame, traits: list[str], default: dict[str, float]) -> DataFrame:
    """Mean of each trait over chunks that have any; defaults where none has."""
    has = F.lit(False)
    for t in traits:
        has = has | F.col(t).isNotNull()
    n = F.count_if(has)
    one = chunks.agg(n.alias("n"), *(F.sum(t).alias(t) for t in traits))
    return one.select("n", *(F.round(F.when(F.col("n") > 0, F.coalesce(t, F.lit(0.0)) / F.col("n")).otherwise(default.get(t, 0.0)), 6).alias(t) for t in traits))


def style(warm: Column, encouraging: Column, playful: Column, clear: Column, concise: Column) -> Column:
    tags = F.concat_ws(
        ", ", F.when(warm > 0.5, "warm"), F.when(encouraging > 0.5, "encouraging"), F.when(playful > 0.4, "lightly playful"), F.when(clear > 0.6, "clear"), F.when(concise > 0.5, "concise")
    )
    return F.when(tags == "", "helpful and clear").otherwise(tags)


def greeting(warm: Column, playful: Column) -> Column:
    return F.when(playful > 0.6, "playful").when(warm > 0.6, "warm").otherwise("plain")
