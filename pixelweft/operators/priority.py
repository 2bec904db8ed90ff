"""Fitting, scoring and evaluating the three-class priority model on feature vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.functions.spectral import ratio
from pixelweft.operators.features import decode
from pixelweft.schemas import FEATURE_NAMES, PRIORITIES

#: Trees, depth and seed of the forest.
TREES, DEPTH, SEED = 120, 4, 42


def fit(vectors: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    forest = RandomForestClassifier(featuresCol="features", labelCol="priority_int", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features"), forest]).fit(vectors)


def scored(vectors: DataFrame, model: PipelineModel) -> DataFrame:
    """vectors with probs (array), predicted_int, predicted, confidence and probabilities (a map, rounded)."""
    x = model.transform(vectors).withColumn("probs", vector_to_array("probability"))
    # a model that saw fewer classes gives fewer probabilities
    x = x.withColumn("probs", F.slice(F.concat("probs", F.array_repeat(F.lit(0.0), 3)), 1, 3))
    x = x.withColumn("predicted_int", (F.array_position("probs", F.array_max("probs")) - 1).cast("int")).withColumn("predicted", decode("predicted_int"))
    named = F.map_from_arrays(F.lit(list(PRIORITIES)), F.transform("probs", lambda p: F.round(p, 4)))
    return x.withColumn("confidence", F.round(F.array_max("probs"), 4)).withColumn("probabilities", named).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel) -> DataFrame:
    """Rows (feature, importance), greatest first."""
    from pyspark.sql import SparkSession

    values = [(n, float(v)) for n, v in zip(FEATURE_NAMES, model.stages[-1].featureImportances.toArray(), strict=True)]
    return SparkSession.active().createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def class_counts(rows: DataFrame, label: str = "priority_label") -> DataFrame:
    names = rows.sparkSession.createDataFrame([(p,) for p in PRIORITIES], f"{label} string")
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return names.join(counts.hint("merge"), label, "left").fillna({"n": 0})


def confusion(rows: DataFrame, label: str = "priority_int", predicted: str = "predicted_int") -> DataFrame:
    """Rows (actual, predicted, n), zero cells included."""
    cells = rows.sparkSession.range(9).select((F.col("id") / 3).cast("int").alias("actual"), (F.col("id") % 3).cast("int").alias("predicted"))
    n = rows.groupBy(F.col(label).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(n.hint("merge"), ["actual", "predicted"], "left").fillna({"n": 0})


def evaluate(rows: DataFrame, label: str = "priority_int", predicted: str = "predicted_int", probs: str | None = None) -> DataFrame:
    """accuracy, macro precision, recall and F1, F1 of each class, Cohen's kappa, and log loss if there are probabilities. One pass."""
    y, p, n = F.col(label), F.col(predicted), F.count(F.lit(1))
    count = lambda c: F.count_if(c)
    parts: list[Column] = [n.alias("n"), count(y == p).alias("hits")]
    for k in range(3):
        parts += [count((y == k) & (p == k)).alias(f"tp{k}"), count(y == k).alias(f"y{k}"), count(p == k).alias(f"p{k}")]
    if probs:
        own = F.element_at(F.col(probs), y.cast("int") + 1)
        parts.append((-F.avg(F.log(F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), own))))).alias("loss"))
    x = rows.agg(*parts)
    c = F.col
    f1 = [ratio(2 * c(f"tp{k}"), c(f"y{k}") + c(f"p{k}"), 12) for k in range(3)]
    mean3 = lambda xs: (xs[0] + xs[1] + xs[2]) / 3
    chance = sum((c(f"y{k}") / c("n")) * (c(f"p{k}") / c("n")) for k in range(3))
    out = [
        c("n"), F.round(c("hits") / c("n"), 6).alias("accuracy"), F.round(mean3([ratio(c(f"tp{k}"), c(f"p{k}"), 12) for k in range(3)]), 6).alias("macro_precision"),
        F.round(mean3([ratio(c(f"tp{k}"), c(f"y{k}"), 12) for k in range(3)]), 6).alias("macro_recall"), F.round(mean3(f1), 6).alias("macro_f1"),
        *(F.round(f, 6).alias(f"f1_{name.lower()}") for f, name in zip(f1, PRIORITIES, strict=True)),
        F.when(chance == 1, 0.0).otherwise(F.round((c("hits") / c("n") - chance) / F.when(chance != 1, 1 - chance), 6)).alias("cohen_kappa"),
    ]
    if probs:
        out.append(F.round("loss", 6).alias("log_loss"))
    return x.where("n > 0").select(*out)
