"""Stores of the query side: chunk, link and vector tables, the encoded archive, traces, graphs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import encode
from lodestone.runtime import maybe_broadcast, number_rows, parallelism


def store_rows(chunks: DataFrame) -> DataFrame:
    """Store rows of loadable chunks with the defaults for what is missing."""
    c = F.col("coordinates")
    return chunks.select(
        "chunk_id",
        F.coalesce(F.nullif("content", F.lit("")), F.lit("")).alias("text"),
        "gate_path",
        *(F.coalesce(c[k], F.lit(0)).alias(k) for k in ("gate_id", "branch_id", "topic_id", "level_id")),
        F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"),
        F.to_json(F.coalesce("prerequisites", F.array().cast("array<array<string>>"))).alias("prerequisites"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("quality_score", F.lit(0.5)).alias("quality_score"),
        F.substring("content", 1, 200).alias("preview"),
    )


def write_store(rows: DataFrame, path: str) -> None:
    """Partitioned by gate and sorted by the rest of the address, so that filters prune files and row groups."""
    rows.repartition("gate_id").sortWithinPartitions("gate_id", "branch_id", "topic_id", "level_id").write.mode("overwrite").partitionBy("gate_id").parquet(path)


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 500) -> None:
    rows.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties)


def vector_rows(nodes: DataFrame) -> DataFrame:
    """Vector table rows with the payload's defaults, keyed by the nodes' own ids."""
    return nodes.select(
        "node_id",
        "vector",
        F.coalesce("gate_id", F.lit(0)).alias("gate_id"),
        F.coalesce("node_type", F.lit("CONCEPT")).alias("node_type"),
        F.coalesce("difficulty_id", F.lit(2)).alias("difficulty_id"),
        F.coalesce("depth", F.lit(3)).alias("depth"),
        F.when(F.coalesce("quality", F.lit(0.0)) == 0, 0.5).otherwise(F.col("quality")).alias("quality"),
    )


def named_vectors(nodes: DataFrame, gates: DataFrame) -> DataFrame:
    """Vector rows with the name of their gate (gates: gate_id, gate), GENERAL for one that has none."""
    names = gates.groupBy("gate_id").agg(F.min("gate").alias("gate"))
    return vector_rows(nodes).join(maybe_broadcast(names), "gate_id", "left").withColumn("gate", F.coalesce("gate", F.lit("GENERAL")))


def versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of a table, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(p))
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return [n for n in names if n.startswith("v") and done(n)]


def merge(rows: DataFrame, path: str, keys: list[str], order: str | None = None) -> DataFrame:
    """Upsert into a table: rows replace those of equal keys; of new rows with one key the last by ``order`` wins.

    A new version is written beside the old one and is valid once it is complete,
    so that a failed merge leaves the table as it was; older versions may be deleted.
    """
    spark = rows.sparkSession
    columns = rows.columns
    best = F.max_by(F.struct(*columns), F.struct(*([order] if order else []), F.xxhash64(*columns)))
    new = rows.groupBy(*keys).agg(best.alias("r")).select("r.*")
    known = versions(spark, path)
    if known:
        old = spark.read.parquet(f"{path}/{known[-1]}")
        new = new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
    target = f"{path}/v{len(known) + 1:06d}" if not known else f"{path}/v{int(known[-1][1:]) + 1:06d}"
    new.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def pages(rows: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """The rows in pages of about ``size`` by ranges of their key, whose bounds come from counted ranges: no offset is skipped twice."""
    numbered = number_rows(rows.select(key), key, name="page_row")
    first = [r[0] for r in numbered.where(F.col("page_row") % size == 0).orderBy(key).select(key).toLocalIterator()]
    for a, b in zip(first, [*first[1:], None], strict=True):
        yield rows.where((F.col(key) >= a) & (F.col(key) < b) if b is not None else F.col(key) >= a)


def spread_payload(rows: DataFrame, payload: str) -> DataFrame:
    """A struct's fields as columns; they replace columns of the same name."""
    inner = rows.schema[payload].dataType.names
    return rows.select(*(F.col(c) for c in rows.columns if c != payload and c not in inner), *(F.col(f"{payload}.{c}") for c in inner))


def stamped(rows: DataFrame, id_name: str = "id", time_name: str = "processed_at") -> DataFrame:
    """Rows with a random id and the time of processing. Neither is the same in a second run."""
    return rows.withColumns({id_name: F.uuid(), time_name: F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")})


def write_quality(rows: DataFrame, path: str, above: float = 0.6) -> None:
    """A table partitioned by whether the quality is above a bound: searches of good rows read those only."""
    good = F.coalesce(F.col("quality") > above, F.lit(False))
    rows.withColumn("good", good).repartition("good", F.pmod(F.xxhash64("node_id"), F.lit(parallelism(rows.sparkSession)))).write.mode("overwrite").partitionBy("good").parquet(path)


def read_good(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("good = 'true'").drop("good")


def write_archive(chunks: DataFrame, path: str, codec: str = "zstd") -> None:
    """Vocabulary and encoded chunks as compressed Parquet."""
    vocab = encode.vocabulary(chunks)
    vocab.write.mode("overwrite").option("compression", codec).parquet(f"{path}/vocabulary")
    vocab = chunks.sparkSession.read.parquet(f"{path}/vocabulary")
    encode.encode(chunks, vocab).write.mode("overwrite").option("compression", codec).parquet(f"{path}/chunks")


def archive_ratio(spark: SparkSession, chunks: DataFrame, path: str) -> float:
    raw = chunks.agg(F.sum(F.octet_length("content")).alias("n")).first().n or 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    packed = files.agg(F.sum("length").alias("n")).first().n or 0
    return raw / packed if packed else 0.0


def write_graph(elements: DataFrame, path: str) -> None:
    """One JSON element a line."""
    elements.select(F.col("element").alias("value")).write.mode("overwrite").text(path)


def write_graphml(lines: DataFrame, path: str) -> None:
    """A GraphML document is one file by its format; its lines come in order."""
    lines.orderBy("part", "name").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """A report of a few rows, as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)
