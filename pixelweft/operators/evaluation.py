"""Evaluation of predictions against a truth and a validity that are tables of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.functions.spectral import ratio

CELL = ("sample", "row", "col")
COUNTS = ("tp", "fp", "fn", "tn", "total_pixels", "valid_pixels", "no_truth", "no_validity", "no_prediction")


def with_ratios(x: DataFrame) -> DataFrame:
    """precision, recall, f1, iou, accuracy and masked_pixels from the counts; 0.0 where there is nothing to divide by."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return x.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "masked_pixels": F.col("total_pixels") - F.col("valid_pixels"),
    })


def cells(prediction: DataFrame, truth: DataFrame, validity: DataFrame | None = None) -> DataFrame:
    """Each predicted cell with its truth and validity, NULL where there is none: (sample, row, col, prob, target, valid).

    Tables that are bucketed by the cell (``sinks.bucketed``) meet where they lie: no exchange.
    """
    x = prediction.select(*CELL, "prob").join(truth.select(*CELL, "target").hint("merge"), list(CELL), "left")
    if validity is None:
        return x.withColumn("valid", F.lit(True))
    return x.join(validity.select(*CELL, "valid").hint("merge"), list(CELL), "left")


def evaluate(prediction: DataFrame, truth: DataFrame, validity: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each sample: counts and ratios over its valid cells.

    A cell counts if it has a finite probability and target and is valid; it is predicted as change above the threshold. What one side lacks is
    counted: predicted cells without truth or validity (they don't count as valid), and cells of the truth that nothing predicts. A cell has one row in each table. Null
    probabilities, targets and validities are not valid. A sample that only the truth has gives a row of zeros.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    ok = F.coalesce(finite("prob") & finite("target") & F.col("valid"), F.lit(False))
    p, t = F.col("prob") > threshold, F.col("target") > 0.5
    hit = lambda c: F.count_if(ok & c)
    found = cells(prediction, truth, validity).groupBy("sample").agg(
        hit(p & t).alias("tp"), hit(p & ~t).alias("fp"), hit(~p & t).alias("fn"), hit(~p & ~t).alias("tn"), F.count(F.lit(1)).alias("total_pixels"), F.count_if(ok).alias("valid_pixels"),
        F.count_if(F.col("target").isNull()).alias("no_truth"), F.count_if(F.col("valid").isNull()).alias("no_validity"),
    )
    left = truth.select(*CELL).join(prediction.select(*CELL).hint("merge"), list(CELL), "left_anti").groupBy("sample").agg(F.count("*").alias("no_prediction"))
    x = found.join(left.hint("merge"), "sample", "full_outer")
    return with_ratios(x.select("sample", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS)))


def overall(per_sample: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The counts of all samples together and the ratios of these (each cell weighs the same), and how many samples there are."""
    sums = [*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS), F.count("*").alias("samples")]
    return with_ratios(per_sample.groupBy(*by).agg(*sums) if by else per_sample.agg(*sums))


def compared(px: DataFrame, scores: dict[str, Column], by: list[str] | None = None, target: str = "target", threshold: float = 0.5) -> DataFrame:
    """One row for each setting: (by, setting, tp, fp, fn, tn and ratios) of all ``scores``, worked out side by side in one pass over the pixels.

    Pixels without a score or a target don't count.
    """
    by = by or []
    t = F.col(target) == 1
    n = {"tp": lambda p: p & t, "fp": lambda p: p & ~t, "fn": lambda p: ~p & t, "tn": lambda p: ~p & ~t}
    names = {f"{i}_{k}": f(F.col(f"_s{i}") > threshold) for i in range(len(scores)) for k, f in n.items()}
    scored = px.select(*by, target, *(c.alias(f"_s{i}") for i, c in enumerate(scores.values())))
    wide = scored.groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in names.items()))
    rows = F.array(*(F.struct(F.lit(s).alias("setting"), *(F.col(f"{i}_{k}").alias(k) for k in n)) for i, s in enumerate(scores)))
    x = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    tp, fp, fn, tn = (F.col(c) for c in n)
    return x.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
