"""Grouped statistics of pair pixels: one pass over the pixels for each, partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.functions.spectral import ratio
from pixelweft.operators.ranking import medians

PIXEL_HA = 0.01
THRESHOLDS = (0.1, 0.2, 0.3)


def tag(t: float) -> str:
    return f"{round(t * 10):02d}"


def ha(pixels: Column, pixel_m2: float = 100.0) -> Column:
    return F.round(pixels * pixel_m2 / 10_000.0, 4)


def describe(px: DataFrame, value: str, by: list[str], prefix: str = "") -> DataFrame:
    """valid, invalid, valid_fraction, min, max, mean, std (population) and median of a column; NULL over no valid pixel.

    The median is exact and found by counting: values are not sorted, and a group of any size is dealt to several tasks."""
    x = F.col(value)
    r = lambda c, n: F.round(c, 6).alias(prefix + n)
    n, all_ = F.count(x), F.count(F.lit(1))
    plain = px.groupBy(*by).agg(
        n.alias(prefix + "valid_pixels"), (all_ - n).alias(prefix + "invalid_pixels"), ratio(n, all_).alias(prefix + "valid_fraction"),
        r(F.min(x), "min"), r(F.max(x), "max"), r(F.avg(x), "mean"), r(F.stddev_pop(x), "std"),
    )
    middle = medians(px, by, value, "_median").select(*by, r(F.col("_median"), "median"))
    return plain.join(middle.hint("merge"), by, "left")


def change_areas(px: DataFrame, by: list[str], value: str = "ndvi_diff", thresholds=THRESHOLDS) -> DataFrame:
    """Pixels and fractions of the valid pixels that lost or gained at least each threshold."""
    x = F.col(value)
    out = [F.count(x).alias("valid_pixels")]
    for t in thresholds:
        for name, hit in (("loss", x <= -t), ("gain", x >= t)):
            out += [F.count_if(hit).alias(f"{name}_{tag(t)}_pixels"), ratio(F.count_if(hit), F.count(x)).alias(f"{name}_{tag(t)}_fraction")]
    return px.groupBy(*by).agg(*out)


def area_columns(pixel_m2: float = 100.0) -> list[Column]:
    """Total, valid and changed areas, rounded in the chain m² or ha to km²."""
    total, valid, changed = F.count(F.lit(1)), F.count_if("valid"), F.count_if("change")
    km2 = lambda n: F.round(ha(n, pixel_m2) / 100.0, 6)
    return [
        total.alias("total_pixels"), valid.alias("valid_pixels"), ratio(valid, total).alias("valid_fraction"),
        ha(total, pixel_m2).alias("total_area_ha"), ha(valid, pixel_m2).alias("valid_area_ha"), km2(total).alias("total_area_km2"),
        changed.alias("changed_pixels"), F.round(changed * pixel_m2, 2).alias("changed_area_m2"), ha(changed, pixel_m2).alias("changed_area_ha"),
        km2(changed).alias("changed_area_km2"), ratio(changed, valid).alias("change_fraction_of_valid"),
    ]


def mean(x: Column | str, where: Column | str) -> Column:
    x, where = (F.col(c) if isinstance(c, str) else c for c in (x, where))
    return F.round(F.avg(F.when(where, x)), 6)


def std(x: Column | str, where: Column | str) -> Column:
    x, where = (F.col(c) if isinstance(c, str) else c for c in (x, where))
    return F.round(F.stddev_pop(F.when(where, x)), 6)


def zone_columns() -> list[Column]:
    """NDVI over the valid pixels and within the change."""
    return [
        mean("ndvi_before", "valid").alias("ndvi_before_mean"), mean("ndvi_after", "valid").alias("ndvi_after_mean"), mean("ndvi_diff", "valid").alias("ndvi_diff_mean"),
        mean("ndvi_before", "change").alias("change_ndvi_before_mean"), mean("ndvi_after", "change").alias("change_ndvi_after_mean"),
        mean("ndvi_diff", "change").alias("change_ndvi_diff_mean"), std("ndvi_diff", "change").alias("change_ndvi_diff_std"),
    ]


def vegetation_columns(pixel_m2: float = 100.0) -> list[Column]:
    """Losses at three thresholds and gain at one, over the valid pixels, and the fraction of severe loss."""
    d = F.when(F.col("valid"), F.col("ndvi_diff"))
    hits = [(f"veg_loss_{{}}_{tag(t)}", F.count_if(d <= -t)) for t in THRESHOLDS] + [("veg_gain_{}_02", F.count_if(d >= 0.2))]
    out = [c.alias(n.format("pixels")) for n, c in hits] + [ha(c, pixel_m2).alias(n.format("ha")) for n, c in hits]
    return [*out, ratio(F.count_if(d <= -0.2), F.count_if("valid")).alias("veg_loss_fraction")]


def delta_columns() -> list[Column]:
    """Mean shifts of the four bands, and of visible brightness, within the change."""
    bright = lambda r: (F.col(f"{r}_b02") + F.col(f"{r}_b03") + F.col(f"{r}_b04")) / 3
    out = [mean(F.col(f"a_{b}") - F.col(f"b_{b}"), "change").alias(f"delta_{b}_mean") for b in ("b02", "b03", "b04", "b08")]
    return [*out, mean(bright("a") - bright("b"), "change").alias("brightness_diff_mean")]


def transition_columns(pixel_m2: float = 100.0) -> list[Column]:
    """Class transitions within the change, and the area of vegetation lost."""
    move = lambda a, b: F.count_if((F.col("scl_before") == a) & (F.col("scl_after") == b) & F.col("change"))
    return [
        move(4, 5).alias("scl_veg_to_nonveg_pixels"), move(4, 6).alias("scl_veg_to_water_pixels"), move(6, 5).alias("scl_water_to_nonveg_pixels"),
        move(5, 4).alias("scl_nonveg_to_veg_pixels"), ha(move(4, 5) + move(4, 6), pixel_m2).alias("scl_veg_loss_ha"),
    ]


def transition_matrix(px: DataFrame, by: list[str]) -> DataFrame:
    """Pixels of each (class before, class after) within the change."""
    return px.where("change").groupBy(*by, "scl_before", "scl_after").agg(F.count("*").alias("pixels"))


def raw_band_stats(long: DataFrame, by: list[str], nodata: int = 0) -> DataFrame:
    """Count, min, max and mean of the readings that aren't nodata."""
    x = F.when(F.col("dn") != nodata, F.col("dn"))
    return long.groupBy(*by).agg(F.count(x).alias("valid_pixels"), F.min(x).alias("min_dn"), F.max(x).alias("max_dn"), F.round(F.avg(x), 3).alias("mean_dn"))


def inference_stats(scored: DataFrame, by: list[str], pixel_m2: float = 100.0) -> DataFrame:
    """Totals of a change mask of 1, 0 and 255."""
    m = F.col("change_mask")
    valid, changed, total = F.count_if(m != 255), F.count_if(m == 1), F.count(F.lit(1))
    area = lambda n: F.round(n * pixel_m2 / 10_000.0, 2)
    return scored.groupBy(*by).agg(
        total.alias("total_pixels"), valid.alias("valid_pixels"), (total - valid).alias("masked_pixels"), changed.alias("change_pixels"),
        F.count_if(m == 0).alias("no_change_pixels"), ratio(changed, valid).alias("change_fraction"), area(changed).alias("change_area_ha"),
        F.round(changed * pixel_m2 / 1_000_000.0, 4).alias("change_area_km2"),
    )
