"""Logical tables over the driver's Parquet tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.runtime import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("CONCEPT", "FORMULA", "PROBLEM", "SKILL"))), (i % 4 + 1).cast("int"))
    return e.select(
        i.alias("node_id"),
        F.col("label").alias("gate_id"),
        kind.alias("node_type"),
        (1 + i % 7).cast("int").alias("depth"),
        (1 + i % 5).cast("int").alias("difficulty_id"),
        (i % 5).cast("int").alias("branch_id"),
        F.when(i % 17 != 0, F.round((i * 37 % 101) / F.lit(100.0), 2)).alias("quality"),
        F.array(F.concat(F.lit("g"), F.col("label")), F.concat(F.lit("b"), i % 5), F.concat(F.lit("t"), i % 3), F.concat(F.lit("l"), i % 5)).alias("path"),
        F.col("embedding").alias("vector"),
    )


NODES = """
    nodes AS (
        SELECT vec_id AS node_id, label AS gate_id, (['CONCEPT', 'FORMULA', 'PROBLEM', 'SKILL'])[vec_id % 4 + 1] AS node_type,
            CAST(1 + vec_id % 7 AS INTEGER) AS depth, CAST(1 + vec_id % 5 AS INTEGER) AS difficulty_id, CAST(vec_id % 5 AS INTEGER) AS branch_id,
            CASE WHEN vec_id % 17 <> 0 THEN round((vec_id * 37 % 101) / 100.0::DOUBLE, 2) END AS quality,
            ['g' || label, 'b' || vec_id % 5, 't' || vec_id % 3, 'l' || vec_id % 5] AS path,
            CAST(embedding AS DOUBLE[]) AS vector
        FROM embeddings
    )"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"))
    rows = e.crossJoin(F.broadcast(e.agg(F.count("*").alias("n"))))  # one row
    links = F.array(
        F.struct((F.col("i").cast("long") / 2).cast("long").alias("to_node"), F.lit("REQUIRES").alias("edge_type")),
        F.when(F.col("i") % 4 == 2, F.struct(((F.col("i") * 7 + 1) % F.col("n")).alias("to_node"), F.lit("EXAMPLE_OF").alias("edge_type"))),
        F.when(F.col("i") % 4 == 3, F.struct(((F.col("i") * 11 + 3) % F.col("n")).alias("to_node"), F.lit("VERIFIES").alias("edge_type"))),
    )
    return rows.select(F.col("i").alias("from_node"), F.explode(F.filter(links, lambda x: x.isNotNull())).alias("l"), ((F.col("i") % 10) / F.lit(10.0)).alias("weight")).select(
        "from_node", "l.to_node", "l.edge_type", "weight"
    )


EDGES = """
    edges AS (
        SELECT vec_id AS from_node, vec_id // 2 AS to_node, 'REQUIRES' AS edge_type, (vec_id % 10) / 10.0::DOUBLE AS weight FROM embeddings
        UNION ALL SELECT vec_id, (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings), 'EXAMPLE_OF', (vec_id % 10) / 10.0::DOUBLE FROM embeddings WHERE vec_id % 4 = 2
        UNION ALL SELECT vec_id, (vec_id * 11 + 3) % (SELECT count(*) FROM embeddings), 'VERIFIES', (vec_id % 10) / 10.0::DOUBLE FROM embeddings WHERE vec_id % 4 = 3
    )"""


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches: every vector whose id is divisible by 100, asked against all."""
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("text"))


def user_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")


USER_QUERIES = "user_queries AS (SELECT concat_ws('-', conv_id, turn) AS query_id, text FROM conversations WHERE role = 'user')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("source").distinct()
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return s.select(F.col("source").alias("file_id"), (number % 5).alias("session_id"), number.alias("uploaded_at"))


FILES = """
    files AS (
        SELECT DISTINCT source AS file_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 5 AS session_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS uploaded_at FROM documents
    )"""


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_id"), F.col("doc_id").cast("long").alias("chunk_index"), F.col("text").alias("content"), F.concat(F.lit("From "), "source", F.lit(" in "), "lang").alias("contextual_content"))


FILE_CHUNKS = "file_chunks AS (SELECT doc_id AS chunk_id, source AS file_id, doc_id AS chunk_index, text AS content, 'From ' || source || ' in ' || lang AS contextual_content FROM documents)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address labels of the documents, some of them invalid or of low confidence."""
    i = F.col("doc_id")
    n = (1 + i % 8).cast("int")
    level = F.element_at(F.array(*(F.lit(x) for x in ("foundation", "intermediate", "advanced", "research", "frontier", "other"))), (i % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"),
        F.when(i % 13 != 0, F.col("source")).alias("gate"),
        F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("p"), k)).alias("path"),
        F.sequence(F.lit(1), F.when(i % 11 == 0, n + 1).otherwise(n)).alias("path_ids"),
        n.alias("depth"),
        level.alias("level"),
        ((i * 31 % 100) / F.lit(100.0)).alias("confidence"),
    )


LABELLED = """
    labelled AS (
        SELECT doc_id AS chunk_id, CASE WHEN doc_id % 13 <> 0 THEN source END AS gate,
            CAST(1 + doc_id % 8 AS INTEGER) AS path_n, CAST(1 + doc_id % 8 AS INTEGER) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS ids_n, CAST(1 + doc_id % 8 AS INTEGER) AS depth,
            (['foundation', 'intermediate', 'advanced', 'research', 'frontier', 'other'])[doc_id % 6 + 1] AS level, (doc_id * 31 % 100) / 100.0::DOUBLE AS confidence
        FROM documents
    )"""


def pathed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with four-part paths that several share, and paths as prerequisites."""
    i = F.col("doc_id")
    path = lambda k: F.array(F.concat(F.lit("g"), k % 3), F.concat(F.lit("b"), k % 5), F.concat(F.lit("t"), k % 7), F.concat(F.lit("l"), k % 2))
    return table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"), path(i).alias("gate_path"), F.array(path(i + 1), path(i * 3 + 2), F.array(F.concat(F.lit("g"), i % 3), F.lit("short"))).alias("prerequisites")
    )


PATHED = """
    pathed AS (
        SELECT doc_id AS chunk_id, ['g' || doc_id % 3, 'b' || doc_id % 5, 't' || doc_id % 7, 'l' || doc_id % 2] AS gate_path,
            [['g' || (doc_id + 1) % 3, 'b' || (doc_id + 1) % 5, 't' || (doc_id + 1) % 7, 'l' || (doc_id + 1) % 2],
             ['g' || (doc_id * 3 + 2) % 3, 'b' || (doc_id * 3 + 2) % 5, 't' || (doc_id * 3 + 2) % 7, 'l' || (doc_id * 3 + 2) % 2], ['g' || doc_id % 3, 'short']] AS prerequisites
        FROM documents
    )"""
