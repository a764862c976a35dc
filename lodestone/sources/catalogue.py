"""The catalogue of sources: what to fetch for each gate, how much of it, and what a person must fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.runtime import fresh, number_rows

SCHEMA = "gate string, source_type string, name string, size_gb double, split string, url string, filter string"
#: Sources that are read by themselves, items of one that are read at most.
AUTOMATIC, MOST_ITEMS = ("huggingface",), 100_000


def catalogue(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    """Rows of a configuration gate -> source type -> list of sources; other entries (totals) are left out."""
    rows = [
        (gate, kind, s["name"], float(s.get("size_gb", 0)), s.get("split"), s.get("url"), s.get("filter"))
        for gate, kinds in config.items()
        for kind, sources in kinds.items()
        if isinstance(sources, list)
        for s in sources
    ]
    return spark.createDataFrame(rows, SCHEMA)


def manual_manifest(sources: DataFrame) -> DataFrame:
    """Sources and GB by type that aren't read by themselves."""
    return sources.where(~F.col("source_type").isin(*AUTOMATIC)).groupBy("source_type").agg(F.count("*").alias("n"), F.round(F.sum("size_gb"), 6).alias("gb"))


def item_limit(size_gb: Column) -> Column:
    """Items that are read of a source of that size."""
    return F.least(F.floor(size_gb * 1024 * 1024 / 10).cast("int"), F.lit(MOST_ITEMS))


def scan(spark: SparkSession, path: str, size_gb: float, form: str = "parquet", order: str | None = None) -> DataFrame:
    """Items of a source that has been fetched, with their numbers from 0: by ``order``, else in the order of the files."""
    most = min(int(size_gb * 1024 * 1024 / 10), MOST_ITEMS)
    rows = spark.read.format(form).load(path)
    place, = fresh(rows, "place")
    rows = rows.withColumn(place, F.monotonically_increasing_id() if order is None else F.col(order))
    return number_rows(rows, place, name="index").where(F.col("index") < most).drop(place)
