"""Scoring, thresholding and evaluating change, and fitting a change scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.functions import spectral as S
from pixelweft.functions.spectral import ratio
from pixelweft.storage import discard, durable

BANDS = ("b02", "b03", "b04", "b08")
INPUTS = [f"{r}_{b}" for r in ("b", "a") for b in BANDS]
SLOPE, CENTRE = 20.0, 0.2


def spectral_score(px: DataFrame) -> DataFrame:
    """change_logit and change_prob from the size of the NDVI change; NULL where the pair is not valid."""
    logit = SLOPE * (F.abs("ndvi_diff") - CENTRE)
    return px.withColumn("change_logit", F.when(F.col("valid"), logit)).withColumn("change_prob", S.sigmoid("change_logit"))


def with_mask(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("change_mask", S.change_mask("change_prob", "valid", threshold).cast("int"))


def pixel_inputs(px: DataFrame) -> tuple[DataFrame, list[str]]:
    """The eight bands and the four absolute differences."""
    deltas = {f"d_{b}": F.abs(F.col(f"a_{b}") - F.col(f"b_{b}")) for b in BANDS}
    return px.withColumns(deltas), [*INPUTS, *deltas]


def fit_scorer(px: DataFrame, label: str = "target", reg: float = 0.01, max_iter: int = 30) -> PipelineModel:
    """Logistic regression on the pixels whose twelve inputs are all there."""
    x, inputs = pixel_inputs(px)
    stages = [VectorAssembler(inputCols=inputs, outputCol="_inputs"), LogisticRegression(featuresCol="_inputs", labelCol=label, regParam=reg, maxIter=max_iter, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred")]
    return Pipeline(stages=stages).fit(x.where(S.all_present(*INPUTS) & F.col("valid")))


def fit_scorers(px: DataFrame, settings: list[dict], label: str = "target") -> list[PipelineModel]:
    """A scorer for each setting (``reg``, ``max_iter``). The inputs are put together and written once, for all of them."""
    x, inputs = pixel_inputs(px)
    assembler = VectorAssembler(inputCols=inputs, outputCol="_inputs")
    rows = durable(assembler.transform(x.where(S.all_present(*INPUTS) & F.col("valid"))).select("_inputs", label), "scorer_inputs")
    lr = LogisticRegression(featuresCol="_inputs", labelCol=label, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred")
    maps = [{lr.regParam: s.get("reg", 0.01), lr.maxIter: s.get("max_iter", 30)} for s in settings]
    fitted = dict(lr.fitMultiple(rows, maps))
    discard(rows)
    return [PipelineModel([assembler, fitted[i]]) for i in range(len(settings))]


def linear_score(model: PipelineModel) -> Column:
    """change_prob of a fitted scorer as a column of its twelve inputs (``pixel_inputs``), so that several can be worked out in one pass; NULL where an input is missing or the pair is not valid."""
    fitted, inputs = model.stages[-1], model.stages[0].getInputCols()
    logit = F.lit(float(fitted.intercept))
    for w, c in zip(fitted.coefficients.toArray(), inputs, strict=True):
        logit = logit + float(w) * F.col(c)
    return F.when(F.col("valid") & S.all_present(*INPUTS), S.sigmoid(logit))


def score(px: DataFrame, model: PipelineModel) -> DataFrame:
    """change_prob from a fitted scorer; NULL where an input is missing or the pair is not valid."""
    x, inputs = pixel_inputs(px)
    ok = F.col("valid") & S.all_present(*INPUTS)
    filled = x.withColumn("_ok", ok).fillna(0.0, subset=inputs)
    out = model.transform(filled).withColumn("change_prob", F.when(F.col("_ok"), vector_to_array("_prob")[1]))
    return out.drop("_inputs", "_raw", "_prob", "_pred", "_ok", *(f"d_{b}" for b in BANDS))


def score_with(px: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], columns: list[str]) -> DataFrame:
    """change_prob from a caller's function of a batch of pixels."""
    schema = T.StructType([*px.schema.fields, T.StructField("change_prob", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = b["valid"].astype(bool) & b[columns].notna().all(axis=1)
            b["change_prob"] = pd.Series(scorer(b[columns].fillna(0.0)), index=b.index).astype("float64").where(ok)
            yield b

    return px.mapInPandas(run, schema)


def confusion(scored: DataFrame, by: list[str], target: str = "target", mask: str = "change_mask") -> DataFrame:
    """tp, fp, fn, tn over the valid pixels, and precision, recall, f1, iou and accuracy; 0.0 where there is nothing to divide by."""
    p, t = F.col(mask) == 1, F.col(target) == 1
    counts = {"tp": p & t, "fp": p & ~t, "fn": ~p & t, "tn": ~p & ~t}
    rows = scored.where(F.col(mask) != 255)
    x = (rows.groupBy(*by) if by else rows).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return metrics(x)


def metrics(x: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return x.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def bce_dice(scored: DataFrame, by: list[str], target: str = "target", eps: float = 1.0) -> DataFrame:
    """Binary cross-entropy on logits, and soft Dice loss, over the valid pixels."""
    x, t, p = F.col("change_logit"), F.col(target).cast("double"), F.col("change_prob")
    bce = F.avg(F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))))
    dice = 1 - (2 * F.sum(p * t) + eps) / (F.sum(p) + F.sum(t) + eps)
    return scored.where(p.isNotNull()).groupBy(*by).agg(F.round(bce, 6).alias("bce"), F.round(dice, 6).alias("dice_loss"))


def weighted_loss(losses: DataFrame, bce_weight: float = 0.5, dice_weight: float = 0.5) -> Column:
    return bce_weight * F.col("bce") + dice_weight * F.col("dice_loss")
