"""Vocabulary, token encoding, clusters and packed coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import maybe_broadcast, number_rows

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t\n\x0B\f\r ]"
MIN_FREQUENCY, CLUSTERS = 5, 500


def tokens(content: Column) -> Column:
    """Words and single marks."""
    return F.regexp_extract_all(content, F.lit(f"({TOKEN})"), 1)


def occurrences(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.posexplode(tokens(F.col("content"))).alias("pos", "token"))


def vocabulary(chunks: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """(token, id, frequency) of frequent tokens; ids count all distinct tokens in order of their first occurrence."""
    # the place of a token as one number, which a hash aggregate can hold
    place = F.col("chunk_id").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("pos")
    counted = occurrences(chunks).groupBy("token").agg(F.count("*").alias("frequency"), F.min(place.cast("decimal(38,0)")).alias("first"))
    return number_rows(counted, "first", name="id").where(F.col("frequency") >= min_frequency).select("token", "id", "frequency")


def encode(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(chunk_id, ids): token ids in order, -1 for unknown ones.

    A vocabulary of checked size is broadcast, so that no token is a key of an exchange; a larger one is
    joined, and adaptive execution splits the common tokens.
    """
    coded = occurrences(chunks).join(maybe_broadcast(vocab.select("token", "id")), "token", "left")
    return coded.groupBy("chunk_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(-1)).alias("id")))), lambda s: s["id"]).alias("ids"))


#: A byte-level BPE vocabulary (50,257 entries) of a public tokenizer.
BPE = "/opt/tokenizers/byte_bpe_50k.json"


def bpe_ids(chunks: DataFrame, vocabulary: str = BPE) -> DataFrame:
    """(chunk_id, ids): byte-level BPE ids of each whole content; none for a null or empty one.

    The vocabulary's text goes with the task, so that executors need no file.
    """
    with open(vocabulary, encoding="utf-8") as f:
        model = chunks.sparkSession.sparkContext.broadcast(f.read())  # some MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model.value)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = t.encode_batch([x or "" for x in part.column("content").to_pylist()], add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column("chunk_id"), pa.array([e.ids for e in found], pa.list_(pa.int32()))], ["chunk_id", "ids"])

    return chunks.select("chunk_id", "content").mapInArrow(run, "chunk_id long, ids array<int>")


def cluster(gate_id: Column) -> Column:
    return F.pmod(gate_id, F.lit(CLUSTERS))


def pack(*parts: Column) -> Column:
    """Bytes of small non-negative coordinates; null if one doesn't fit."""
    fits = parts[0].between(0, 255)
    for p in parts[1:]:
        fits = fits & p.between(0, 255)
    return F.when(fits, F.unhex(F.concat(*(F.lpad(F.hex(p.cast("long")), 2, "0") for p in parts))))


def ratio(raw: Column, packed: Column) -> Column:
    return F.round(F.try_divide(raw, packed), 6)
