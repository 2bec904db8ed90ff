"""Checks as rows: (keys, check, passed), so that a report is one more query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.functions.spectral import all_present, finite, usable_class
from pixelweft.operators import grid
from pixelweft.schemas import BAND_ORDER, CLASS_NAMES, POLICIES, RESOLUTION_M


def stacked(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()))
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.check", "p.passed")


def band_stats(pixels: DataFrame, keys: list[str], nodata: int = 0) -> DataFrame:
    """One row for each keys and band: counts and statistics of the usable readings."""
    x = F.col("dn").cast("double")
    good = F.when(finite(x).isNotNull() & (x != nodata), x)
    return pixels.groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("n"), F.count(good).alias("usable"), F.count_if(finite(x).isNull()).alias("non_finite"), F.count_if(x == nodata).alias("nodata_pixels"),
        F.min(good).alias("min"), F.max(good).alias("max"), F.round(F.avg(good), 3).alias("mean"), F.round(F.stddev_pop(good), 3).alias("std"),
        F.round(F.count(good) / F.count(F.lit(1)), 6).alias("valid_fraction"),
    )


def band_checks(pixels: DataFrame, keys: list[str], nodata: int = 0) -> DataFrame:
    """Checks of each observation's bands: presence, variation, sensor range, finite and valid readings."""
    s = band_stats(pixels, keys, nodata)
    of = lambda b, c: F.bool_or(F.when(F.col("band") == b, c))
    per = {f"band_readable_{b}": of(b, F.lit(True)) for b in BAND_ORDER}
    per |= {f"band_has_variation_{b}": of(b, (F.col("usable") > 0) & (F.col("std") > 0)) for b in BAND_ORDER}
    per |= {f"band_values_in_sensor_range_{b}": of(b, (F.col("min") >= 0) & (F.col("max") <= 65535)) for b in BAND_ORDER}
    known = F.col("band").isin(list(BAND_ORDER))
    per |= {
        "bands_present": F.count_distinct(F.when(known, F.col("band"))) == len(BAND_ORDER), "no_non_finite_pixels": F.sum("non_finite") == 0,
        "has_valid_pixels": F.min("valid_fraction") > 0, "mostly_valid_pixels": F.min("valid_fraction") >= 0.99,
    }
    return stacked(s.groupBy(*keys).agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in per.items())), keys, {n: F.col(n) for n in per})


def meta_checks(meta: DataFrame, keys: list[str]) -> DataFrame:
    """Checks of each observation's band geometry: one reference system, one grid, 10 m."""
    affine = F.struct("a", "b", "c", "d", "e", "f")
    per = {
        "crs_valid": F.count_if(F.col("crs").isNull()) == 0, "crs_consistent_across_bands": F.count_distinct("crs") == 1,
        "resolution_is_10m": F.bool_and((F.abs(F.abs("a") - RESOLUTION_M) <= 1e-6) & (F.abs(F.abs("e") - RESOLUTION_M) <= 1e-6)),
        "bands_share_grid": (F.count_distinct(F.struct("width", "height")) == 1) & (F.count_distinct(affine) == 1),
    }
    return stacked(meta.groupBy(*keys).agg(*(c.alias(n) for n, c in per.items())), keys, {n: F.col(n) for n in per})


def missing_bands(pixels: DataFrame, scenes: DataFrame, key: str = "scene_id") -> DataFrame:
    """Rows (scene, role, band) of bands that a scene ought to have and has no reading of."""
    wanted = scenes.select(key, F.explode(F.array(F.lit("before"), F.lit("after"))).alias("role")).select(key, "role", F.explode(F.lit(list(BAND_ORDER))).alias("band"))
    return wanted.join(pixels.select(key, "role", "band").distinct().hint("merge"), [key, "role", "band"], "left_anti")


def class_checks(px: DataFrame, keys: list[str], scl: str = "scl") -> DataFrame:
    """Class data is there, its codes are known, and it has usable pixels."""
    x = px.groupBy(*keys).agg(F.count(scl).alias("n"), F.count_if(~F.col(scl).isin(list(CLASS_NAMES))).alias("unknown"), F.count_if(usable_class(scl)).alias("usable"))
    return stacked(x, keys, {"scl_present": F.col("n") > 0, "scl_classes_known": F.col("unknown") == 0, "scl_has_usable_pixels": F.col("usable") > 0})


def crs_checks(pairs: DataFrame, key: str = "scene_id") -> DataFrame:
    """Rows with before_crs and after_crs: present, convertible and metric (UTM), and whether identical."""
    b, a = F.col("before_crs"), F.col("after_crs")
    utm = grid.utm_zone("before_crs").isNotNull() & grid.utm_zone("after_crs").isNotNull()
    lonlat = b.isin("EPSG:4326") | a.isin("EPSG:4326")
    return stacked(pairs, [key], {"crs_present": b.isNotNull() & a.isNotNull(), "crs_transformable_to_analysis_crs": (b == a) | utm | lonlat, "crs_units_metric": utm, "crs_identical": b == a})


def bounds_overlap(pairs: DataFrame, key: str = "scene_id") -> DataFrame:
    """Rows with boxes b_minx.. and a_minx..: overlap_km2, overlap_fraction of the smaller, and two checks."""
    x = pairs.withColumns({f"i_{k}": c for k, c in grid.intersection("b_", "a_").items()})
    area = lambda p: (F.col(f"{p}maxx") - F.col(f"{p}minx")) * (F.col(f"{p}maxy") - F.col(f"{p}miny"))
    shared, least = F.coalesce(area("i_"), F.lit(0.0)), F.least(area("b_"), area("a_"))
    share = F.when(least > 0, shared / F.when(least > 0, least)).otherwise(0.0)
    return x.select(
        key, F.round(shared / 1e6, 3).alias("overlap_km2"), F.round(share, 6).alias("overlap_fraction"), (shared > 0).alias("bounds_overlap"), (share >= 0.25).alias("overlap_covers_smaller_footprint")
    )


def processed_checks(px: DataFrame, key: str = "scene_id") -> DataFrame:
    """Checks of pair pixels: mask algebra, ranges, share of valid pixels, masks within class masks."""
    bands = [f"{r}_{b.lower()}" for r in ("b", "a") for b in BAND_ORDER]
    inside = F.lit(True)
    for b in bands:
        inside = inside & (F.col(b).isNull() | F.col(b).between(0, 1))
    n = F.count(F.lit(1))
    per = {
        "shared_is_before_and_after": F.bool_and(F.col("valid") == (F.col("valid_before") & F.col("valid_after"))), "reflectance_in_range": F.bool_and(inside),
        "ndvi_in_range": F.bool_and((F.col("ndvi_before").isNull() | F.col("ndvi_before").between(-1, 1)) & (F.col("ndvi_after").isNull() | F.col("ndvi_after").between(-1, 1))),
        "ndvi_difference_in_range": F.bool_and(F.col("ndvi_diff").isNull() | F.col("ndvi_diff").between(-2, 2)), "mostly_valid": F.count_if("valid") / n > 0.99,
        "valid_has_usable_class": F.bool_and(~F.col("valid") | (usable_class("scl_before") & usable_class("scl_after"))), "usable_in_both": F.count_if("valid") / n >= 0.5,
        "classes_known": F.bool_and(F.col("scl_before").isin(list(CLASS_NAMES)) & F.col("scl_after").isin(list(CLASS_NAMES))),
    }
    return stacked(px.groupBy(key).agg(*(c.alias(k) for k, c in per.items())), [key], {k: F.col(k) for k in per})


def model_input_checks(px: DataFrame, key: str = "scene_id", fill: float = 0.0) -> DataFrame:
    """What a consumer that takes no NULL is given: filled, in range, and not all empty."""
    bands = [f"{r}_{b.lower()}" for r in ("b", "a") for b in BAND_ORDER]
    x = px.fillna(fill, subset=bands)
    inside = F.lit(True)
    for b in bands:
        inside = inside & F.col(b).between(0, 1)
    means = [F.avg(b) > 0 for b in bands]
    positive = means[0]
    for m in means[1:]:
        positive = positive & m
    per = {"no_nulls": F.bool_and(all_present(*bands)), "in_range": F.bool_and(inside), "mean_positive": positive}
    return stacked(x.groupBy(key).agg(*(c.alias(k) for k, c in per.items())), [key], {k: F.col(k) for k in per})


def report(checks: DataFrame, keys: list[str]) -> DataFrame:
    """passed, and the names of the checks that failed."""
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("problems"))


def request_problems(requests: DataFrame) -> DataFrame:
    """Requests with problems, an array of messages; accepted ones have none."""
    c = F.col
    bad = {
        "longitude out of range": ~(c("min_lon").between(-180, 180) & c("max_lon").between(-180, 180)), "latitude out of range": ~(c("min_lat").between(-90, 90) & c("max_lat").between(-90, 90)),
        "min_lon must be less than max_lon": c("min_lon") >= c("max_lon"), "min_lat must be less than max_lat": c("min_lat") >= c("max_lat"),
        "before_date must precede after_date": c("before_date") >= c("after_date"), "change_threshold must lie in [0, 1]": ~c("change_threshold").between(0, 1),
        "unknown scl_policy": ~c("scl_policy").isin(list(POLICIES)), "pixel_resolution_m must be positive": c("pixel_resolution_m") <= 0,
        "missing field": ~all_present("min_lon", "min_lat", "max_lon", "max_lat", "before_date", "after_date"),
    }
    messages = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in bad.items())))
    return requests.withColumn("problems", messages).withColumn("accepted", F.size("problems") == 0)
