"""Model hooks: encoder, recogniser, triplet and label models, text generation.

Each is a callable on DataFrames or strings; the defaults are deterministic
stand-ins, so that everything runs without models or a network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import graph


def stub_generate(prompt: str, temperature: float) -> str:
    """Answers with words of the prompt: the hotter, the fewer."""
    words = prompt.split()
    return " ".join(words[: max(1, int(len(words) * (1 - temperature / 2)))][-40:])


@dataclass
class Hooks:
    encode: Callable[[Column], Column] = V.hashed_embedding
    entities: Callable[[DataFrame], DataFrame] = graph.capitalised_entities
    triplets: Callable[[DataFrame], DataFrame] = graph.cooccurrence_triplets
    generate: Callable[[str, float], str] = field(default=stub_generate)
    #: (query_id, text) -> (query_id, predicted, predicted_confidence)
    classify: Callable[[DataFrame], DataFrame] | None = None


def train_router(examples: DataFrame, features: int = 1 << 12, seed: int = 42):
    """A logistic regression on hashed TF-IDF of (text, label), and its held-out accuracy (80/20)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    fit, test = examples.randomSplit([0.8, 0.2], seed)
    stages = [
        StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep"),
        RegexTokenizer(inputCol="text", outputCol="w", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="w", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", maxIter=20, regParam=0.01),
    ]
    model = Pipeline(stages=stages).fit(fit)
    accuracy = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy").evaluate(model.transform(test))
    return model, accuracy


def predict(model, queries: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    labels = F.array(*(F.lit(x) for x in model.stages[0].labels))
    out = model.transform(queries.withColumn("label", F.lit(model.stages[0].labels[0])))
    p = vector_to_array("probability")
    return out.select("query_id", F.get(labels, F.col("prediction").cast("int")).alias("predicted"), F.array_max(p).alias("predicted_confidence"))
