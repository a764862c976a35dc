"""Cleaning and rejection of chunks, with a reason for each rejected row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.runtime import materialize, number_rows


def clean_chunks(chunks: DataFrame, mode: str = "faithful", every: int = 20) -> DataFrame:
    """content, quality_score, content type and ``reason`` (null: kept) of every chunk.

    Of the chunks that aren't technical, each ``every``-th (in order of chunk_id)
    is checked for its language, told by the beginning of the cleaned text; only English passes.
    """
    c = chunks.select("chunk_id", "source", T.fix_unicode(F.col("content")).alias("content")).withColumn("is_technical", T.content_type(F.col("content"))["is_technical"])
    c = c.select("chunk_id", "source", "is_technical", (F.coalesce("content", F.lit("")) == "").alias("empty"), T.clean(F.col("content"), F.col("is_technical"), mode).alias("cleaned"))
    # the cleaned text is read several times below: for the sample, the lengths and the quality
    c = materialize(c, "cleaned")
    blank = F.col("empty") | (F.col("cleaned") == "")
    checked = sampled(c.where(~blank & ~F.col("is_technical")).select("chunk_id"), every).withColumn("checked", F.lit(True))
    c = c.join(checked, "chunk_id", "left")
    n = F.length("cleaned")
    reason = (
        F.when(blank, "too_short")
        .when(F.col("checked") & (T.language(F.col("cleaned")) != "en"), "non_english")
        .when(n < T.SHORT, "too_short")
        .when(n > T.LONG, "too_long")
    )
    c = c.withColumn("quality_score", F.round(T.quality(F.col("cleaned"), F.col("is_technical")), 6))
    return c.select(
        "chunk_id",
        "source",
        F.col("cleaned").alias("content"),
        "quality_score",
        "is_technical",
        F.coalesce(reason, F.when(F.col("quality_score") < T.LOW_QUALITY, "low_quality")).alias("reason"),
    )


def sampled(chunks: DataFrame, every: int) -> DataFrame:
    """Each ``every``-th row by chunk_id."""
    return number_rows(chunks, "chunk_id", name="_n").where((F.col("_n") + 1) % every == 0).drop("_n")


def reject_stats(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
