"""Scene-class reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.functions.spectral import class_name, ratio, usable_class
from pixelweft.schemas import CLASS_NAMES, MASK_REASONS, STRICT


def class_histogram(px: DataFrame, by: list[str], scl: str = "scl", classes: Iterable[int] = STRICT) -> DataFrame:
    """Rows (by, class, name, pixels, fraction, usable); missing codes make a row with a NULL class."""
    counts = px.groupBy(*by, F.col(scl).alias("class")).agg(F.count("*").alias("pixels"))
    # as many rows as a scene has classes
    total = F.sum("pixels").over(Window.partitionBy(*by))
    return counts.select(
        *by, "class", F.when(F.col("class").isNull(), "non_finite").otherwise(class_name("class")).alias("name"), "pixels",
        ratio(F.col("pixels"), total).alias("fraction"), usable_class("class", classes).alias("usable"),
    )


def mask_report(px: DataFrame, by: list[str], scl: str = "scl", classes: Iterable[int] = STRICT) -> DataFrame:
    """One row a group: pixels, usable and masked pixels with fractions, pixels for each reason, unknown codes."""
    c = F.col(scl)
    usable, all_ = F.count_if(usable_class(c, classes)), F.count(F.lit(1))
    reasons = [F.count_if(c.isin(list(codes))).alias(f"{name}_pixels") for name, codes in MASK_REASONS.items()]
    unknown = F.sort_array(F.collect_set(F.when(~c.isin(list(CLASS_NAMES)), c)))
    return px.groupBy(*by).agg(
        all_.alias("pixels"), usable.alias("usable_pixels"), (all_ - usable).alias("masked_pixels"), ratio(usable, all_).alias("usable_fraction"),
        ratio(all_ - usable, all_).alias("masked_fraction"), *reasons, unknown.alias("unknown_classes"),
    )


def observation_mask(px: DataFrame, classes_table: DataFrame | None, keys: list[str], scene: list[str], classes: Iterable[int] = STRICT) -> DataFrame:
    """px with scl, scl_available and scl_valid; without class data for a scene every pixel is usable, and that is told."""
    if classes_table is None:
        return px.withColumn("scl", F.lit(None).cast("int")).withColumn("scl_available", F.lit(False)).withColumn("scl_valid", F.lit(True))
    have = classes_table.select(*scene).distinct().withColumn("scl_available", F.lit(True))
    x = px.join(classes_table.select(*keys, "scl").hint("merge"), keys, "left").join(have.hint("merge"), scene, "left")
    x = x.withColumn("scl_available", F.coalesce("scl_available", F.lit(False))).withColumn("scl", F.when(F.col("scl_available"), F.coalesce("scl", F.lit(0))))
    return x.withColumn("scl_valid", F.when(~F.col("scl_available"), True).otherwise(usable_class("scl", classes)))
