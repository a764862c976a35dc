"""Reasoning loop over a batch of problems, confidence by agreement, and the trace table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lodestone.functions import text as T
from lodestone.hooks import Hooks
from lodestone.runtime import materialize, small_batches

#: Rounds, variance below which samples agree, temperatures of the samples.
ROUNDS, AGREE, TEMPERATURES = 10, 0.05, (0.3, 0.5, 0.7, 0.9)
#: Nodes that a problem's context has, and those of them that a step's prompt shows.
CONTEXTS, SHOWN = 5, 3
TRACE = "query_id string, iteration int, x_stream string, y_stream string, z_stream array<string>, nodes_used array<long>, verification_passed boolean, verification_details string"


def word_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' word sets; 0 if one has none."""
    x, y = (F.array_distinct(T.words(F.lower(t))) for t in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def agreement(samples: DataFrame) -> DataFrame:
    """query_id, confidence, confident of (query_id, answer, sample): one minus the variance of similarities."""
    s = samples.withColumn("s", F.when(F.col("sample").isNull(), 0.5).otherwise(word_jaccard(F.col("answer"), F.col("sample"))))
    v = F.var_pop("s")
    return s.groupBy("query_id").agg(F.round(1 - v, 6).alias("confidence"), (v < AGREE).alias("confident"))


def verify(context_verifiers: Column) -> Column:
    """The first verifier of the context, which passes; without one it passes as well."""
    return F.struct(F.lit(True).alias("passed"), F.coalesce(F.get(context_verifiers, F.lit(0)), F.lit("none")).alias("verifier"))


def context_verifiers(context: DataFrame, verifiers: DataFrame) -> DataFrame:
    """(query_id, verifiers): names of all verifiers (node_id, verifier, weight) of a query's context (query_id, node_id, rank), nearest and heaviest first."""
    rows = context.select("query_id", "node_id", "rank").join(verifiers, "node_id")
    order = F.struct("rank", (-F.col("weight")).alias("w"), "verifier")
    found = rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["verifier"]).alias("verifiers"))
    return context.select("query_id").distinct().join(found, "query_id", "left")


def append_trace(trace: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose (query_id, iteration) is new are added; of new rows with one key, any one."""
    new = rows.dropDuplicates(["query_id", "iteration"]).join(trace.select("query_id", "iteration"), ["query_id", "iteration"], "left_anti")
    return trace.unionByName(new)


def step_prompt(x: str, y: str, z: list[str], context: list[str]) -> str:
    steps = "\n".join(f"{i + 1}. {s}" for i, s in enumerate(z[-3:])) or "none"
    return f"Problem: {x}\nAnswer so far: {y or 'none'}\nSteps: {steps}\nKnowledge: {' | '.join(context[:SHOWN]) or 'none'}\nNext step:"


def answer_prompt(x: str, z: list[str]) -> str:
    """All steps, from which the answer is put together."""
    return f"Answer: {x} " + " ".join(z)


#: A problem after a round: its answer and steps, the nodes and the check of its context, and the answers that are compared with its own.
_TURN = "query_id string, x string, y string, z array<string>, nodes array<long>, passed boolean, verifier string, samples array<string>"
#: Problems that a round writes at once.
TURNS = 500


def _turns(generate: Callable[[str, float], str]):
    """A round of (query_id, x, y, z, context, passed, verifier), problem by problem."""
    schema = to_arrow_schema(_parse_datatype_string(_TURN))

    def turn(r: dict) -> dict:
        context, z, y, samples = r.pop("context") or [], list(r["z"]), r["y"], []
        try:
            z.append(generate(step_prompt(r["x"], y, z, [c["content"] or "" for c in context[:SHOWN]]), 0.6))
            y = generate(answer_prompt(r["x"], z), 0.2)
        except Exception as e:  # a model's failure is a step that says so
            z.append(f"[Error generating reasoning step: {e}]")
        for t in TEMPERATURES:
            try:
                samples.append(generate(answer_prompt(r["x"], z), t))
            except Exception:
                samples.append(None)
        return r | {"y": y, "z": z, "nodes": [c["node_id"] for c in context], "samples": samples}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TURNS):
                yield pa.RecordBatch.from_pylist([turn(r) for r in batch.slice(at, TURNS).to_pylist()], schema)

    return run


def solve(
    problems: DataFrame | list[tuple[str, str]],
    retrieve: Callable[[DataFrame], DataFrame],
    spark,
    hooks: Hooks | None = None,
    rounds: int = ROUNDS,
    verifiers: DataFrame | None = None,
    term: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers and trace of any number of user problems (query_id, text); of rows with one id, the greatest text counts.

    ``retrieve`` maps (query_id, text) to (query_id, node_id, content), best
    first or with a column ``rank``; each round is one plan over all problems
    that are still open, which is written once, as a model need not answer
    twice alike. With ``term``, that expression of the text is what is looked
    for, once for all problems that have it in common. The answer is checked by
    the first of the ``verifiers`` (node_id, verifier, weight) of its context.
    """
    hooks = hooks or Hooks()
    if not isinstance(problems, DataFrame):
        problems = spark.createDataFrame(list(dict(problems).items()), "query_id string, text string")
    text = F.coalesce(F.max("text"), F.lit(""))
    live = problems.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(text.alias("x"), F.lit("").alias("y"), F.array().cast("array<string>").alias("z"))
    live, done, traces = materialize(live, "problems"), [], []
    ends = [F.lit("uncertain").alias("status"), F.lit(0.5).alias("confidence")]
    n = 0
    while n < rounds and not live.isEmpty():
        asked = F.concat("x", F.lit(" Current thinking: "), F.coalesce("y", F.lit("")))
        open_ = live.withColumn("key", F.col("query_id") if term is None else term(asked))
        keys = open_.select(F.col("key").alias("query_id"), asked.alias("text")) if term is None else open_.where("key is not null").select(F.col("key").alias("query_id"), F.col("key").alias("text")).distinct()
        found = retrieve(keys)
        rank = F.col("rank") if "rank" in found.columns else F.monotonically_increasing_id()
        rows = found.select("query_id", F.struct(rank.alias("rank"), F.col("node_id").cast("long").alias("node_id"), F.col("content").cast("string").alias("content")).alias("c"))
        best = rows.groupBy(F.col("query_id").alias("key")).agg(F.slice(F.sort_array(F.collect_list("c")), 1, CONTEXTS).alias("c"))
        contexts = materialize(best.select("key", F.transform("c", lambda c, i: F.struct(c["node_id"].alias("node_id"), F.when(i < SHOWN, c["content"]).alias("content"))).alias("context")), "contexts")
        checks = (F.lit(True).alias("passed"), F.lit("none").alias("verifier"))
        if verifiers is not None:
            ranked = contexts.select(F.col("key").alias("query_id"), F.posexplode("context.node_id").alias("rank", "node_id"))
            contexts = contexts.join(context_verifiers(ranked, verifiers).withColumnRenamed("query_id", "key"), "key", "left")
            checks = (verify(F.col("verifiers"))["passed"].alias("passed"), verify(F.col("verifiers"))["verifier"].alias("verifier"))
        turned = open_.join(contexts, "key", "left").select("query_id", "x", "y", "z", "context", *checks)
        with small_batches(spark):
            turned = materialize(turned.mapInArrow(_turns(hooks.generate), _TURN), "turns")
        traces.append(turned.select("query_id", F.lit(n).alias("iteration"), F.col("x").alias("x_stream"), F.col("y").alias("y_stream"), F.col("z").alias("z_stream"), F.col("nodes").alias("nodes_used"), F.col("passed").alias("verification_passed"), F.col("verifier").alias("verification_details")))
        n += 1
        agreed = agreement(turned.select("query_id", F.col("y").alias("answer"), F.explode("samples").alias("sample")))
        state = materialize(turned.select("query_id", "x", "y", "z").join(agreed, "query_id"), "answers")
        sure = F.coalesce("confident", F.lit(False))
        done.append(state.where(sure).select("query_id", F.col("y").alias("answer"), F.lit("confident").alias("status"), "confidence", F.lit(n).alias("rounds")))
        live = state.where(~sure).select("query_id", "x", "y", "z")
    answers = live.select("query_id", F.col("y").alias("answer"), *ends, F.lit(n).alias("rounds"))
    # a problem is in a round once, so that no row of the trace is there before
    return reduce(DataFrame.unionByName, done, answers), reduce(DataFrame.unionByName, traces, spark.createDataFrame([], TRACE))
