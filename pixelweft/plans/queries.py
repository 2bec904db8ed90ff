"""The registered queries of the imagery operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.operators import catalog, change, datasets, explain, features, grid, ledger, masking, patches, priority, resample, stats, validate
from pixelweft.plans import derived, prepared, reports, warped  # noqa: F401  (reports and warped register their queries with prepared)
from pixelweft.schemas import FEATURE_NAMES, LENIENT
from pixelweft.sources import pixels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(prepared.QUERIES)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def ndvi_change_areas(spark, sf_dir):
    return stats.change_areas(pixels.pairs(spark, sf_dir), ["scene_id"])


@query
def ndvi_pixels(spark, sf_dir):
    r = lambda c: F.round(c, 9).alias(c)
    return pixels.pairs(spark, sf_dir).select("scene_id", "row", "col", r("ndvi_before"), r("ndvi_after"), r("ndvi_diff"), "valid")


@query
def ndvi_describe(spark, sf_dir):
    return stats.describe(pixels.pairs(spark, sf_dir), "ndvi_diff", ["scene_id"])


@query
def observation_summary(spark, sf_dir):
    from pixelweft.functions import spectral as S

    readings = pixels.long(pixels.order_pixels(spark, sf_dir)).withColumn("x", S.reflectance(S.clean_dn("dn")))
    return stats.describe(readings, "x", ["scene_id", "role", "band"])


@query
def pair_from_readings(spark, sf_dir):
    return pixels.from_long(pixels.long(pixels.order_pixels(spark, sf_dir)))


@query
def raw_band_stats(spark, sf_dir):
    return stats.raw_band_stats(pixels.long(pixels.order_pixels(spark, sf_dir)), ["scene_id", "role", "band"])


def class_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"scl_{r}").alias("scl")) for r in ("before", "after")))
    return pixels.order_pixels(spark, sf_dir).select("scene_id", F.explode(sides).alias("p")).select("scene_id", "p.*")


@query
def scl_histogram(spark, sf_dir):
    return masking.class_histogram(class_readings(spark, sf_dir), ["scene_id", "role"])


@query
def scl_mask_report(spark, sf_dir):
    return masking.mask_report(class_readings(spark, sf_dir), ["scene_id", "role"]).drop("unknown_classes")


@query
def pair_valid_fraction(spark, sf_dir):
    n = lambda c: F.count_if(c)
    from pixelweft.functions.spectral import ratio

    return pixels.pairs(spark, sf_dir).groupBy("scene_id").agg(n("valid_before").alias("before_pixels"), n("valid_after").alias("after_pixels"), n("valid").alias("shared_pixels"), ratio(n("valid"), F.count(F.lit(1))).alias("shared_fraction"))


@query
def lenient_vs_strict(spark, sf_dir):
    px = pixels.pairs(spark, sf_dir).withColumnRenamed("valid", "strict")
    px = pixels.with_indexes(px.drop("valid_before", "valid_after", "ndvi_before", "ndvi_after", "ndvi_diff", "change"), LENIENT)
    return px.groupBy("scene_id").agg(F.count_if("strict").alias("strict_pixels"), F.count_if("valid").alias("lenient_pixels"))


def _per_scene(columns) -> Query:
    return lambda spark, sf_dir: pixels.pairs(spark, sf_dir).groupBy("scene_id").agg(*columns())


QUERIES |= {
    "area_accounting": _per_scene(stats.area_columns), "change_zone_stats": _per_scene(stats.zone_columns), "veg_thresholds": _per_scene(stats.vegetation_columns),
    "band_deltas": _per_scene(stats.delta_columns), "scl_transitions": _per_scene(stats.transition_columns),
}


@query
def transition_matrix(spark, sf_dir):
    return stats.transition_matrix(pixels.pairs(spark, sf_dir), ["scene_id"])


def _runs(spark, sf_dir):
    return patches.runs(pixels.pairs(spark, sf_dir).where("change").select("scene_id", "row", "col"))


@query
def change_runs(spark, sf_dir):
    return _runs(spark, sf_dir).drop("run")


@query
def patch_sizes(spark, sf_dir):
    return patches.patch_sizes(patches.label(_runs(spark, sf_dir))).drop("patch")


@query
def patch_stats(spark, sf_dir):
    return patches.patch_stats(patches.patch_sizes(patches.label(_runs(spark, sf_dir)))).drop("patch_sizes_ha")


def scene_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.extract(pixels.pairs(spark, sf_dir))


@query
def feature_rows(spark, sf_dir):
    return scene_features(spark, sf_dir).drop("patch_sizes_ha")


@query
def feature_vector(spark, sf_dir):
    return features.vector(scene_features(spark, sf_dir), ["scene_id"])


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rule_label(features.vector(scene_features(spark, sf_dir), ["scene_id"]))


@query
def rule_priority(spark, sf_dir):
    return ruled(spark, sf_dir).drop(*FEATURE_NAMES)


@query
def class_counts(spark, sf_dir):
    return priority.class_counts(ruled(spark, sf_dir))


@query
def summary_rows(spark, sf_dir):
    return features.summary_rows(scene_features(spark, sf_dir), ["scene_id"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.with_mask(change.spectral_score(pixels.pairs(spark, sf_dir)))


@query
def change_mask(spark, sf_dir):
    return scored(spark, sf_dir).select("scene_id", "row", "col", F.round("change_prob", 9).alias("change_prob"), "change_mask")


@query
def inference_stats(spark, sf_dir):
    return stats.inference_stats(scored(spark, sf_dir), ["scene_id"])


@query
def confusion_metrics(spark, sf_dir):
    return change.confusion(scored(spark, sf_dir), ["scene_id"])


@query
def bce_dice(spark, sf_dir):
    return change.bce_dice(scored(spark, sf_dir), ["scene_id"])


@query
def target_fractions(spark, sf_dir):
    return pixels.pairs(spark, sf_dir).groupBy("scene_id").agg(F.round(F.avg("target"), 6).alias("change_fraction"))


@query
def band_validation(spark, sf_dir):
    return validate.band_checks(pixels.long(pixels.order_pixels(spark, sf_dir)), ["scene_id", "role"])


@query
def processed_validation(spark, sf_dir):
    return validate.processed_checks(pixels.pairs(spark, sf_dir))


@query
def validation_report(spark, sf_dir):
    found = validate.report(validate.processed_checks(pixels.pairs(spark, sf_dir)), ["scene_id"])
    return found.select("scene_id", "passed", F.array_join("problems", ",").alias("problems"))


@query
def class_checks(spark, sf_dir):
    return validate.class_checks(class_readings(spark, sf_dir), ["scene_id", "role"])


@query
def missing_bands(spark, sf_dir):
    readings = pixels.long(pixels.order_pixels(spark, sf_dir)).where("not (scene_id % 3 = 1 and role = 'after' and band = 'B08')")
    return validate.missing_bands(readings, readings.select("scene_id").distinct())


@query
def request_checks(spark, sf_dir):
    x = validate.request_problems(derived.requests(spark, sf_dir))
    return x.select("analysis_id", "accepted", F.array_join("problems", "; ").alias("problems"))


@query
def scene_search(spark, sf_dir):
    import datetime as dt

    found = catalog.search(derived.scenes(spark, sf_dir), dt.datetime(1994, 1, 1), dt.datetime(1997, 12, 31), 40.0, (20.0, 10.0, 40.0, 30.0))
    return found.select("item_id", "cloud_cover_percent", "tile")


@query
def scene_pick(spark, sf_dir):
    found = catalog.pick_pair(derived.scenes(spark, sf_dir), ["aoi"], F.lit("T3"))
    return found.select("aoi", "role", "item_id", "tile", "cloud_cover_percent")


@query
def common_grid(spark, sf_dir):
    return grid.common_grid(derived.rasters(spark, sf_dir), ["scene_id"]).select("scene_id", "crs", "a", "c", "e", "f", "width", "height")


@query
def bounds_checks(spark, sf_dir):
    g = grid.properties(derived.rasters(spark, sf_dir))
    side = lambda role, p: g.where(F.col("role") == role).select("scene_id", *(F.col(k).alias(p + k) for k in ("minx", "miny", "maxx", "maxy")))
    return validate.bounds_overlap(side("before", "b_").join(side("after", "a_"), "scene_id"))


def _red(spark, sf_dir):
    return pixels.order_pixels(spark, sf_dir).select("scene_id", "row", "col", F.expr("nullif(dn_b_b04, 0)").alias("dn"))


def _grids(spark, sf_dir, x: str, y: str, size: float, width: int, height: int):
    s = pixels.order_pixels(spark, sf_dir).select("scene_id").distinct()
    return s.selectExpr("scene_id", f"{size}D as a", f"{x} as c", f"-{size}D as e", f"{y} as f", f"{width} as width", f"{height} as height")


def _resampled(spark, sf_dir, kernel, target):
    source = _grids(spark, sf_dir, "500000.0D", "2000000.0D", 10.0, 100, 15)
    x = resample.resample(_red(spark, sf_dir), source, target, ["scene_id"], ["scene_id"], kernel)
    return x.select("scene_id", "row", "col", F.round("dn", 6).alias("dn"))


@query
def resample_bilinear(spark, sf_dir):
    return _resampled(spark, sf_dir, "bilinear", _grids(spark, sf_dir, "500003.0D", "1999996.0D", 10.0, 100, 15))


@query
def resample_nearest(spark, sf_dir):
    return _resampled(spark, sf_dir, "nearest", _grids(spark, sf_dir, "500052.0D", "1999968.0D", 10.0, 100, 15))


@query
def resample_average(spark, sf_dir):
    return _resampled(spark, sf_dir, "average", _grids(spark, sf_dir, "500000.0D", "2000000.0D", 20.0, 50, 8))


@query
def paired_stems(spark, sf_dir):
    return datasets.paired_names(derived.parts(spark, sf_dir), ["A", "B", "label"])[0]


@query
def orphans(spark, sf_dir):
    return datasets.paired_names(derived.parts(spark, sf_dir), ["A", "B", "label"])[1]


@query
def split_leakage(spark, sf_dir):
    return datasets.leakage(derived.splits(spark, sf_dir))


@query
def unresolved_regions(spark, sf_dir):
    present = derived.orders(spark, sf_dir).selectExpr("concat('r', k % 400) as region")
    return datasets.unresolved(derived.splits(spark, sf_dir), present)


@query
def stratified_split(spark, sf_dir):
    x = datasets.stratified_split(derived.orders(spark, sf_dir).select("k", "status"), "status", "k", order=F.expr("k * 7919 % 10007"))
    return x.select("k", "status", "split")


@query
def region_split(spark, sf_dir):
    x = derived.orders(spark, sf_dir).selectExpr("k", "c % 25 as region")
    return datasets.location_split(x, "region", order=F.expr("region * 7919 % 10007")).select("k", "region", "split")


@query
def best_epoch(spark, sf_dir):
    x = derived.orders(spark, sf_dir).selectExpr("c % 20 as run", "k as epoch", "(k * 31 % 1000) / 1000.0D as iou")
    return datasets.best_epoch(x, "iou", ["run"])


@query
def dataset_union(spark, sf_dir):
    x = derived.orders(spark, sf_dir)
    both = datasets.concatenated(x.where("status = 'F'").select("k", "price"), x.where("status = 'O'").select("k", "price"))
    return both.groupBy("dataset").agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@query
def dataset_summary(spark, sf_dir):
    x = pixels.order_pixels(spark, sf_dir).selectExpr("scene_id", "scene_id % 3 as dataset", "target")
    return datasets.summary(datasets.change_fractions(x, ["dataset", "scene_id"]), ["dataset"])


@query
def multiclass_metrics(spark, sf_dir):
    x = derived.orders(spark, sf_dir).selectExpr("cast(k % 3 as int) as y", "cast(if(k % 7 = 0, k + 1, k) % 3 as int) as p")
    return priority.evaluate(x, "y", "p")


@query
def multiclass_confusion(spark, sf_dir):
    x = derived.orders(spark, sf_dir).selectExpr("k % 3 as y", "if(k % 7 = 0, k + 1, k) % 3 as p")
    return priority.confusion(x, "y", "p")


def _ledger(spark, sf_dir):
    x = derived.orders(spark, sf_dir)
    runs = x.selectExpr("concat('run-', k) as analysis_id", "ts as created_at", "if(k % 5 = 0, 'failed', 'complete') as status")
    pr = x.where("k % 5 != 0").selectExpr("concat('run-', k) as analysis_id", "element_at(array('LOW', 'MEDIUM', 'HIGH'), cast(k % 3 as int) + 1) as priority", "(k % 100) / 100.0D as confidence")
    ch = x.where("k % 5 != 0").selectExpr("concat('run-', k) as analysis_id", "(k % 977) / 10.0D as changed_area_ha")
    return runs, pr, ch


@query
def history_rows(spark, sf_dir):
    return ledger.history(*_ledger(spark, sf_dir))


@query
def history_page(spark, sf_dir):
    """The second page of twenty, newest first."""
    return ledger.page(ledger.history(*_ledger(spark, sf_dir)), 20, 20)


@query
def aoi_boxes(spark, sf_dir):
    from pixelweft.functions import spectral as S

    r = derived.requests(spark, sf_dir)
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    return r.select("analysis_id", S.bbox_area_km2(*box).alias("area_km2"), S.bbox_wkt(*(F.round(c, 1) for c in box)).alias("wkt"))


@query
def run_states(spark, sf_dir):
    r = derived.requests(spark, sf_dir).select("analysis_id", "before_date")
    k = F.expr("cast(substring(analysis_id, 5) as long)")
    have = r.select("analysis_id", F.explode(F.when(k % 10 == 3, F.array(F.lit("before"))).otherwise(F.array(F.lit("before"), F.lit("after")))).alias("role"))
    checks = r.select("analysis_id", F.lit("bands_present").alias("check"), (k % 6 != 5).alias("passed"))
    return ledger.run_states(r, have, checks).select("analysis_id", "status", "error")


def _assessed(spark, sf_dir):
    """All scenes, and a model fitted on three quarters of them."""
    rows = ruled(spark, sf_dir)
    return rows, priority.fit(rows.where("scene_id % 4 != 3"))


@query
def priority_scores(spark, sf_dir):
    rows, model = _assessed(spark, sf_dir)
    return priority.scored(rows, model).select("scene_id", (F.col("scene_id") % 4 == 3).alias("held_out"), "predicted", "confidence", "priority_label")


@query
def attributions(spark, sf_dir):
    rows, model = _assessed(spark, sf_dir)
    return explain.attributions(priority.scored(rows, model), model, ["scene_id"])


@query
def priority_assessments(spark, sf_dir):
    rows, model = _assessed(spark, sf_dir)
    x = explain.assess(rows, model, ["scene_id"])
    return x.select("scene_id", "predicted", "confidence", "action_insight", F.size("top_drivers").alias("drivers"))


@query
def global_importance(spark, sf_dir):
    rows, model = _assessed(spark, sf_dir)
    return explain.global_importance(explain.attributions(priority.scored(rows, model), model, ["scene_id"]))


@query
def fitted_change_scores(spark, sf_dir):
    px = pixels.pairs(spark, sf_dir)
    x = change.with_mask(change.score(px, change.fit_scorer(px)))
    return change.confusion(x, ["scene_id"])
