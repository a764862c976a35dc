"""JSON-lines sources and sinks, resumption, budgets, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.runtime import fresh, running_total

#: Fields of an item in order of preference, and the answers that follow.
CONTENT_FIELDS = ["problem", "question", "text", "content", "prompt", "instruction", "input", "code"]
ANSWER_FIELDS = ["solution", "answer", "output", "response"]
MIN_CONTENT = 50
RAW_SCHEMA = "url string, url_hash string, title string, content string, content_hash string, source string, gate string, metadata struct<dataset:string, index:long, fetched_at:string>"


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows, and the lines that aren't JSON objects."""
    parsed = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # bytes that aren't UTF-8 are left out
    value = F.replace(F.make_valid_utf8("value"), F.lit("\uFFFD"), F.lit(""))
    lines = spark.read.text(path).select(value.alias("value"), "_metadata").where(F.trim("value") != "")
    rows = lines.select(parsed.alias("r"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size")).select("r.*", "_file", "_size")
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("_bad", "_file")


def error_counts(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(file, rows, errors) of each file."""
    n = lambda df, c: df.groupBy("_file").agg(F.count("*").alias(c))
    both = n(good, "rows").join(n(bad, "errors"), "_file", "full")
    return both.select(F.regexp_extract("_file", "([^/]+)$", 1).alias("file"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("errors", F.lit(0)).alias("errors"))


def smallest_first(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """The files of a folder by size, the order in which they are worth handling."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return [r.path for r in files.orderBy("length", "path").toLocalIterator()]


def backup(progress: DataFrame, path: str, stamp: str) -> DataFrame:
    """A copy of a progress table beside it, named by a time stamp."""
    progress.write.mode("errorifexists").parquet(f"{path}-{stamp}")
    return progress.sparkSession.read.parquet(f"{path}-{stamp}")


def first_lines(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows of each file."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy(order))).where(F.col("_n") <= n).drop("_n")


def extract_content(row: DataFrame) -> Column:
    """The preferred field and every answer, two line breaks apart; else the whole item as JSON."""
    fields = set(row.columns)
    main = [F.col(f) for f in CONTENT_FIELDS if f in fields]
    answers = [F.nullif(F.col(f), F.lit("")) for f in ANSWER_FIELDS if f in fields]
    whole = F.to_json(F.struct(*row.columns))
    if not main:
        return whole
    first = T.first_present(main)
    return F.when(first.isNotNull(), F.concat_ws("\n\n", first, *answers)).otherwise(whole)


def as_chunks(rows: DataFrame, dataset: str, gate: str) -> DataFrame:
    """Raw chunks of items with a column ``index``; short ones go."""
    content = extract_content(rows.drop("index"))
    out = rows.select("index", content.alias("content")).where(F.length("content") >= MIN_CONTENT)
    name = F.lit(dataset)
    return out.select(
        F.concat(F.lit("hf://"), name, F.lit("/"), "index").alias("url"),
        F.sha2(F.concat(name, F.lit("_"), "index"), 256).alias("url_hash"),
        F.concat(name, F.lit("#"), "index").alias("title"),
        "content",
        F.sha2("content", 256).alias("content_hash"),
        name.alias("source"),
        F.lit(gate).alias("gate"),
        "index",
    )


def within_budget(rows: DataFrame, budget_bytes: int, by: str, order: str, text: str) -> DataFrame:
    """Rows of each group up to and including that which fills the budget."""
    before, = fresh(rows, "before")
    return running_total(rows, by, order, F.octet_length(text), before).where(F.col(before) < budget_bytes).drop(before)


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in the progress table."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def dataset_id(gate: Column, name: Column) -> Column:
    return F.concat(gate, F.lit("_"), F.replace(name, F.lit("/"), F.lit("_")))


def file_name(gate: Column) -> Column:
    return F.replace(F.lower(gate), F.lit("-"), F.lit("_"))


def write_by_gate(chunks: DataFrame, path: str) -> None:
    chunks.withColumn("gate_file", file_name(F.col("gate"))).write.mode("append").partitionBy("gate_file").json(path)


def write_failures(failures: DataFrame, path: str) -> None:
    failures.select("item_id", "url", "gate", "error", "context").write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Leaves an output that is there as it is."""
    df.write.mode("ignore").parquet(path)
