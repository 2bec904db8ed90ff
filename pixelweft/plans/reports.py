"""Registered queries of evaluation, training and explanation, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.functions import spectral as S
from pixelweft.operators import analysis, change, datasets, evaluation, explain
from pixelweft.plans import derived
from pixelweft.plans.oracles import DERIVED, PIXELS, READINGS, SCORED, ratio, with_
from pixelweft.plans.prepared import SHARED, query
from pixelweft.schemas import BAND_ORDER, ROLES
from pixelweft.sources import pixels, sinks
from pixelweft.storage import durable

_ratios = f"{ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {ratio('tp', 'tp + fp + fn')} AS iou, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy"

# --- three relations: each lacks some cells, and the truth has some that nothing predicts


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    px = change.spectral_score(pixels.pairs(spark, sf_dir)).withColumnRenamed("scene_id", "sample")
    key = F.expr("sample * 1500 + row * 100 + col")
    keys = list(evaluation.CELL)
    return (
        sinks.bucketed(px.where(key % 19 != 0).select(*keys, F.col("change_prob").alias("prob")), "prediction", keys, 8),
        sinks.bucketed(px.where(key % 23 != 0).select(*keys, "target"), "truth", keys, 8),
        sinks.bucketed(px.where(key % 29 != 0).select(*keys, ((key % 5 != 0) & F.col("valid")).alias("valid")), "validity", keys, 8),
    )


THREE = f"""
pred AS (SELECT scene_id AS sample, row, col, change_prob AS prob FROM scored WHERE (scene_id * 1500 + row * 100 + col) % 19 <> 0),
truth AS (SELECT scene_id AS sample, row, col, target FROM px WHERE (scene_id * 1500 + row * 100 + col) % 23 <> 0),
vals AS (SELECT scene_id AS sample, row, col, (scene_id * 1500 + row * 100 + col) % 5 <> 0 AND valid AS ok FROM px WHERE (scene_id * 1500 + row * 100 + col) % 29 <> 0),
met AS (SELECT p.sample AS ps, t.sample AS ts, v.sample AS vs, coalesce(p.sample, t.sample) AS sample, prob > 0.5 AS p, target = 1 AS t, coalesce(prob IS NOT NULL AND target IS NOT NULL AND ok, false) AS good
  FROM pred p FULL JOIN truth t USING (sample, row, col) LEFT JOIN vals v ON v.sample = coalesce(p.sample, t.sample) AND v.row = coalesce(p.row, t.row) AND v.col = coalesce(p.col, t.col)),
counts AS (SELECT sample, count(*) FILTER (good AND p AND t) AS tp, count(*) FILTER (good AND p AND NOT t) AS fp, count(*) FILTER (good AND NOT p AND t) AS fn, count(*) FILTER (good AND NOT p AND NOT t) AS tn,
  count(ps) AS total_pixels, count(*) FILTER (good) AS valid_pixels, count(*) FILTER (ps IS NOT NULL AND ts IS NULL) AS no_truth, count(*) FILTER (ps IS NOT NULL AND vs IS NULL) AS no_validity, count(*) FILTER (ps IS NULL) AS no_prediction FROM met GROUP BY sample)"""


@query(with_(PIXELS, SCORED, THREE) + f"SELECT *, {_ratios}, total_pixels - valid_pixels AS masked_pixels FROM counts")
def evaluation_report(spark, sf_dir):
    """Predictions against truth and validity, tables of their own, sample by sample."""
    return evaluation.evaluate(*_three(spark, sf_dir))


_sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in evaluation.COUNTS)


@query(with_(PIXELS, SCORED, THREE, f"sums AS (SELECT {_sums}, count(*) AS samples FROM counts)") + f"SELECT *, {_ratios}, total_pixels - valid_pixels AS masked_pixels FROM sums")
def evaluation_total(spark, sf_dir):
    """The same over all samples together."""
    return evaluation.overall(evaluation.evaluate(*_three(spark, sf_dir)))


# --- several settings in one pass

SETTINGS = {"plain": (20.0, 0.2), "early": (10.0, 0.13), "late": (30.0, 0.31), "flat": (1.0, 0.05)}


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = {n: F.when(F.col("valid"), S.sigmoid(slope * (F.abs("ndvi_diff") - centre))) for n, (slope, centre) in SETTINGS.items()}
    return evaluation.compared(pixels.pairs(spark, sf_dir), scores)


_given = " UNION ALL ".join(f"SELECT '{n}' AS setting, target = 1 AS t, 1 / (1 + exp(-({s}::DOUBLE * (abs(ndvi_diff) - {c}::DOUBLE)))) > 0.5 AS p FROM px WHERE valid" for n, (s, c) in SETTINGS.items())
COMPARED = f"compared AS (SELECT setting, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM ({_given}) GROUP BY setting)"


@query(with_(PIXELS, COMPARED) + f"SELECT *, {_ratios} FROM compared")
def setting_metrics(spark, sf_dir):
    """Four given scores side by side: one pass over the pixels."""
    return _settings(spark, sf_dir)


@query(with_(PIXELS, COMPARED) + f"SELECT setting, iou FROM (SELECT setting, {ratio('tp', 'tp + fp + fn')} AS iou, CASE setting WHEN 'plain' THEN 0 WHEN 'early' THEN 1 WHEN 'late' THEN 2 ELSE 3 END AS n FROM compared) ORDER BY iou DESC, n LIMIT 1")
def best_setting(spark, sf_dir):
    """The setting that a training keeps: the best by IoU, of ties the first."""
    place = F.array_position(F.lit(list(SETTINGS)), F.col("setting")).cast("int")
    return datasets.best_epoch(_settings(spark, sf_dir).withColumn("epoch", place), "iou").select("setting", "iou")


BATCH = "m AS (SELECT scene_id, CASE WHEN change_prob IS NULL THEN 255 WHEN change_prob > 0.7 THEN 1 ELSE 0 END AS m FROM scored)"


@query(with_(PIXELS, SCORED, BATCH) + f"""SELECT scene_id, count(*) AS total_pixels, count(*) FILTER (m <> 255) AS valid_pixels, count(*) FILTER (m = 255) AS masked_pixels, count(*) FILTER (m = 1) AS change_pixels, count(*) FILTER (m = 0) AS no_change_pixels,
{ratio('count(*) FILTER (m = 1)', 'count(*) FILTER (m <> 255)')} AS change_fraction, round(count(*) FILTER (m = 1) * 100.0::DOUBLE / 10000.0::DOUBLE, 2) AS change_area_ha, round(count(*) FILTER (m = 1) * 100.0::DOUBLE / 1000000.0::DOUBLE, 4) AS change_area_km2 FROM m GROUP BY scene_id""")
def batch_inference(spark, sf_dir):
    """Change in all scenes at once, at another threshold."""
    return analysis.infer(pixels.pairs(spark, sf_dir), threshold=0.7)[1]


# --- a given forest, explained: leaves (shares of three classes, path); the SQL plays the game over all coalitions

_F = ("changed_area_ha", "veg_loss_ha_02", "patch_count")
#: Leaves of two trees of two levels: class shares over both trees, and (feature, above, up to, share of weight) on the path.
FOREST = [
    ((0.40, 0.08, 0.02), ((0, None, 60.0, 0.6), (1, None, 40.0, 0.7))), ((0.20, 0.25, 0.05), ((0, None, 60.0, 0.6), (1, 40.0, None, 0.3))),
    ((0.10, 0.30, 0.10), ((0, 60.0, None, 0.4), (2, None, 30.0, 0.5))), ((0.02, 0.08, 0.40), ((0, 60.0, None, 0.4), (2, 30.0, None, 0.5))),
    ((0.35, 0.10, 0.05), ((2, None, 70.0, 0.8), (1, None, 90.0, 0.9))), ((0.15, 0.30, 0.05), ((2, None, 70.0, 0.8), (1, 90.0, None, 0.1))),
    ((0.05, 0.15, 0.30), ((2, 70.0, None, 0.2), (0, None, 100.0, 0.25))), ((0.01, 0.09, 0.40), ((2, 70.0, None, 0.2), (0, 100.0, None, 0.75))),
]


def _game(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    import numpy as np

    from pixelweft.schemas import FEATURE_NAMES

    index = [FEATURE_NAMES.index(f) for f in _F]
    forest = [(np.array(shares), [(index[f], -math.inf if lo is None else lo, math.inf if hi is None else hi, z) for f, lo, hi, z in path]) for shares, path in FOREST]
    x = derived.orders(spark, sf_dir).select("k", (F.col("k") % 3).cast("int").alias("predicted_int"), *(((F.col("k") * (7 + 4 * _F.index(n)) % 131).cast("double") if n in _F else F.lit(0.0)).alias(n) for n in FEATURE_NAMES))
    return explain.attributions(x, forest, ["k"]).where(F.col("feature").isin(list(_F)))


def _goes(path, feature: int) -> str:
    """Of the coalition ``s`` (a bit for each feature): what a leaf's share is worth through one feature."""
    for f, lo, hi, z in path:
        if f == feature:
            test = " AND ".join([f"x{f} > {lo}"] * (lo is not None) + [f"x{f} <= {hi}"] * (hi is not None))
            return f"CASE WHEN (s >> {f}) & 1 = 1 THEN CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {z}::DOUBLE END"
    return "1.0::DOUBLE"


_worth = ", ".join(" + ".join(f"{shares[c]}::DOUBLE * " + " * ".join(f"({_goes(path, f)})" for f in range(3)) for shares, path in FOREST) + f" AS v{c}" for c in range(3))
_gains = " UNION ALL ".join(f"SELECT a.k, {c} AS class_int, '{n}' AS feature, any_value(a.x{i}) AS feature_value, round(sum((b.v{c} - a.v{c}) * CASE bit_count(a.s) WHEN 1 THEN 1 / 6.0::DOUBLE ELSE 1 / 3.0::DOUBLE END), 9) + 0.0::DOUBLE AS shap_value FROM worth a JOIN worth b ON a.k = b.k AND b.s = a.s + {1 << i} WHERE (a.s >> {i}) & 1 = 0 GROUP BY a.k" for c in range(3) for i, n in enumerate(_F))
GAME = f"""rows AS (SELECT k, {", ".join(f"CAST(k * {7 + 4 * i} % 131 AS DOUBLE) AS x{i}" for i in range(3))} FROM o),
worth AS (SELECT k, x0, x1, x2, s, {_worth} FROM rows, (SELECT unnest(range(8)) AS s)), gains AS ({_gains})"""


@query(with_(DERIVED, GAME) + "SELECT k, class_int, feature, feature_value, shap_value FROM gains")
def game_attributions(spark, sf_dir):
    """Attributions of a given forest. The SQL adds up what each feature brings to every coalition of the others."""
    return _game(spark, sf_dir).select("k", "class_int", "feature", "feature_value", (F.round("shap_value", 9) + F.lit(0.0)).alias("shap_value"))


@query(with_(DERIVED, GAME) + "SELECT feature, round(avg(abs(shap_value)), 7) AS mean_abs FROM gains GROUP BY feature")
def game_importance(spark, sf_dir):
    """Mean sizes of these attributions."""
    return explain.global_importance(_game(spark, sf_dir)).select("feature", F.round("mean_abs", 7).alias("mean_abs"))


@query(with_(DERIVED, GAME) + "SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY abs(shap_value) DESC, feature) AS INTEGER) AS rank, feature FROM (SELECT k, class_int, feature, round(shap_value, 7) AS shap_value FROM gains) WHERE class_int = k % 3")
def game_drivers(spark, sf_dir):
    """The ranking of the three features for each row's own class."""
    x = _game(spark, sf_dir).withColumn("shap_value", F.round("shap_value", 7))
    return explain.drivers(x, ["k"], order="absolute").select("k", "rank", "feature")


# --- from requests to the ledger


def _scene_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A request for each scene, some of them refused and some without an observation; the catalogue's scenes; and the pixels."""
    px = pixels.pairs(spark, sf_dir)
    s = px.select("scene_id").distinct()
    requests = s.selectExpr(
        "concat('a', scene_id) as analysis_id", "70.0D as min_lon", "if(scene_id % 5 = 4, 69.0D, 70.5D) as max_lon", "18.0D as min_lat", "18.25D as max_lat", "date'2024-01-01' as before_date", "date'2024-05-01' as after_date",
        "(30 + scene_id % 4 * 20) / 100.0D as change_threshold", "if(scene_id % 7 = 6, 'loose', 'strict') as scl_policy", "10.0D as pixel_resolution_m",
    )
    roles = F.explode(F.when(F.col("scene_id") % 5 == 3, F.array(F.lit("before"))).otherwise(F.array(F.lit("before"), F.lit("after")))).alias("role")
    scenes = s.select("scene_id", roles).selectExpr("concat('a', scene_id) as analysis_id", "role", "concat(role, '-', scene_id) as item_id", "date'2024-01-03' as acquired", "scene_id / 4.0D as cloud_cover_percent", "'EPSG:32643' as crs")
    return requests, scenes, px.withColumn("scene_id", F.concat(F.lit("a"), F.col("scene_id").cast("string")))


LEDGER = f"""
asked AS (SELECT DISTINCT scene_id, 'a' || scene_id AS analysis_id, (30 + scene_id % 4 * 20) / 100.0::DOUBLE AS threshold, concat_ws('; ', CASE WHEN scene_id % 5 = 4 THEN 'min_lon must be less than max_lon' END, CASE WHEN scene_id % 7 = 6 THEN 'unknown scl_policy' END) AS problems FROM px),
states AS (SELECT *, CASE WHEN problems <> '' THEN 'failed' WHEN scene_id % 5 = 3 THEN 'no_data' ELSE 'complete' END AS status, CASE WHEN problems <> '' THEN 'refused: ' || problems WHEN scene_id % 5 = 3 THEN 'observations are missing' END AS error FROM asked),
found AS (SELECT scene_id, count(*) AS total_pixels, count(*) FILTER (valid AND change_prob > threshold) AS changed_pixels FROM scored JOIN asked USING (scene_id) GROUP BY scene_id)"""


@query(with_(PIXELS, SCORED, LEDGER) + """SELECT analysis_id, status, error, 70.0::DOUBLE AS min_lon, CASE WHEN done THEN 'before-' || scene_id || ',after-' || scene_id END AS observations, CASE WHEN done THEN 20 ELSE 0 END AS features, CASE WHEN done THEN 3 ELSE 0 END AS artifacts,
CASE WHEN done THEN total_pixels END AS total_pixels, CASE WHEN done THEN changed_pixels END AS changed_pixels, CASE WHEN done THEN round(changed_pixels / 100.0::DOUBLE, 4) END AS changed_area_ha, CASE WHEN done THEN threshold END AS threshold FROM (SELECT *, status = 'complete' AS done FROM states LEFT JOIN found USING (scene_id))""")
def analysed_requests(spark, sf_dir):
    """Requests are created as runs, analysed, finished, and read back as documents: each has its row, refused ones too."""
    import datetime as dt

    from pixelweft.operators import ledger
    from pixelweft.plans.prepared import _folder

    requests, scenes, px = _scene_requests(spark, sf_dir)
    folder, now = _folder(spark, "ledger"), dt.datetime(2024, 6, 1)
    ledger.create_runs(requests.select("analysis_id", F.lit(now).alias("created_at"), F.struct("before_date", "after_date", "change_threshold").alias("parameters")), folder)
    ledger.finish_runs(analysis.analyse(requests, scenes, px, finished_at=now), folder)
    x = ledger.documents({name: ledger.read(spark, folder, name) for name in ledger.SCHEMAS})
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    items = F.array_join(F.transform(F.sort_array("observations", asc=False), lambda o: o["item_id"]), ",")
    return x.select("analysis_id", "status", "error", "aoi.min_lon", F.when(F.col("observations").isNotNull(), items).alias("observations"), n("features").alias("features"), n("artifacts").alias("artifacts"), "change.total_pixels", "change.changed_pixels", "change.changed_area_ha", "change.threshold")


# --- documents


def _grids_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.pixel_store(spark, sf_dir).select("scene_id").distinct().selectExpr("scene_id", "'EPSG:32643' as crs", "10.0D as a", "0.0D as b", "500000.0D as c", "0.0D as d", "-10.0D as e", "2000000.0D as f", "100 as width", "15 as height")


_files = "string_agg(output, ',' ORDER BY output) AS outputs"


@query(with_(PIXELS) + f"""SELECT scene_id, 'EPSG:32643' AS crs, 100 AS width, {ratio('count(*) FILTER (valid)', 'count(*)')} AS shared, count(*) FILTER (NOT valid) AS masked_pixels, count(*) FILTER (scl_after IN (8, 9)) AS after_cloud_pixels, round(avg(ndvi_diff), 6) AS ndvi_mean, round(median(ndvi_diff), 6) AS ndvi_median,
count(*) FILTER (ndvi_diff <= -0.2) AS loss_02_pixels, 8 AS checks, 'after,before,ndvi_difference,scl_after,scl_before' AS outputs, true AS hashed FROM px GROUP BY scene_id""")
def pair_documents(spark, sf_dir):
    """Documents of prepared pairs, with the records of the files that hold their layers."""
    from pixelweft.operators import documents
    from pixelweft.plans.prepared import _folder

    px = pixels.pairs(spark, sf_dir)
    seen = px.select("scene_id").distinct().select("scene_id", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("role"))
    folder = _folder(spark, "pair")
    sinks.document(documents.pair_documents(px, _grids_of(spark, sf_dir), seen, folder), f"{folder}/metadata")
    x = spark.read.json(f"{folder}/metadata")
    report = F.filter("cloud_mask.reports", lambda r: r["role"] == "after")[0]
    whole = F.forall("outputs", lambda o: (F.length(o["sha256"]) == 64) & (o["bytes"] > 0))
    return x.select(
        F.col("scene_id").cast("long").alias("scene_id"), "grid.crs", F.col("grid.width").cast("int").alias("width"), F.col("nodata_policy.shared_valid_fraction").alias("shared"), "cloud_mask.masked_pixels", report["cloud_pixels"].alias("after_cloud_pixels"),
        F.col("ndvi.difference.mean").alias("ndvi_mean"), F.col("ndvi.difference.median").alias("ndvi_median"), "ndvi.change_areas.loss_02_pixels", F.size("validation").alias("checks"), F.array_join(F.array_distinct(F.transform("outputs", lambda o: o["output"])), ",").alias("outputs"), whole.alias("hashed"),
    )


#: Scenes that 3 divides keep their gaps, of which they have too many; every fifth has its after date elsewhere. The gaps of others hold a 1.
RAW = """
raw AS (SELECT scene_id, role, band, CASE WHEN scene_id % 3 = 0 THEN dn ELSE greatest(dn, 1) END AS dn FROM readings),
per_band AS (SELECT scene_id, role, band, count(*) FILTER (dn <> 0) AS usable, count(*) AS n, coalesce(round(stddev_pop(dn) FILTER (dn <> 0), 3) > 0, false) AS varies FROM raw GROUP BY ALL),
sides AS (SELECT scene_id, 'before' AS role, scl_before AS scl FROM base UNION ALL SELECT scene_id, 'after', scl_after FROM base),
problems AS (
  SELECT scene_id, role || ': band_has_variation_' || band AS p FROM per_band WHERE NOT varies
  UNION ALL SELECT scene_id, role || ': band_values_in_sensor_range_' || band FROM per_band WHERE usable = 0
  UNION ALL SELECT scene_id, role || ': has_valid_pixels' FROM per_band GROUP BY scene_id, role HAVING min(usable) = 0
  UNION ALL SELECT scene_id, role || ': mostly_valid_pixels' FROM per_band GROUP BY scene_id, role HAVING min(round(usable / n, 6)) < 0.99
  UNION ALL SELECT scene_id, role || ': scl_has_usable_pixels' FROM sides GROUP BY scene_id, role HAVING count(*) FILTER (scl IN (4, 5, 6)) = 0
  UNION ALL SELECT DISTINCT scene_id, 'bounds: ' || c FROM base, (VALUES ('bounds_overlap'), ('overlap_covers_smaller_footprint')) v(c) WHERE scene_id % 5 = 1),
verdicts AS (SELECT scene_id, string_agg(p, ',' ORDER BY p) AS problems FROM (SELECT DISTINCT scene_id FROM base) LEFT JOIN problems USING (scene_id) GROUP BY scene_id),
j AS (SELECT c.scene_id, b.scene_id IS NOT NULL AND b.scl_before IN (4, 5, 6) AND a.scene_id IS NOT NULL AND a.scl_after IN (4, 5, 6) AS ok,
  CASE WHEN b.b_b08 IS NULL THEN 0 ELSE (b.b_b08 - b.b_b04) / (b.b_b08 + b.b_b04) END AS nb, CASE WHEN a.a_b08 IS NULL THEN 0 ELSE (a.a_b08 - a.a_b04) / (a.a_b08 + a.a_b04) END AS na
  FROM cells c LEFT JOIN pw b ON b.scene_id = c.scene_id AND b.row = c.row + 3 AND b.col = c.col + 5 LEFT JOIN pw a ON a.scene_id = c.scene_id AND a.row = c.row AND a.col = c.col),
shares AS (SELECT scene_id, count(*) FILTER (NOT coalesce(ok, false)) AS masked_pixels, round(avg(na - nb) FILTER (ok), 6) AS ndvi_mean FROM j GROUP BY scene_id)"""


@query(with_(PIXELS, READINGS, SHARED, RAW) + """SELECT scene_id, problems IS NULL AS passed, coalesce(problems, '') AS problems, CASE WHEN problems IS NULL THEN 95 ELSE 0 END AS width, CASE WHEN problems IS NULL THEN masked_pixels ELSE 0 END AS masked_pixels,
CASE WHEN problems IS NULL THEN ndvi_mean END AS ndvi_mean, CASE WHEN problems IS NULL THEN 2 ELSE 0 END AS observations, CASE WHEN problems IS NULL THEN 'after,before,ndvi_difference,scl_after,scl_before' ELSE '' END AS outputs FROM verdicts LEFT JOIN shares USING (scene_id)""")
def preprocessed_scenes(spark, sf_dir):
    """All scenes from raw readings to documents: those that fail a check have their problems instead."""
    from pixelweft.operators import preprocess
    from pixelweft.plans.prepared import _folder, _meta, _rasters

    px = pixels.order_pixels(spark, sf_dir)
    sides = F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"scl_{r}").alias("scl")) for r in ("before", "after")))
    classes = px.select("scene_id", "row", "col", F.explode(sides).alias("p")).select("scene_id", "p.role", "row", "col", "p.scl")
    raw = pixels.long(px).withColumn("dn", F.expr("if(scene_id % 3 = 0, dn, greatest(dn, 1))"))
    away = F.expr("if(scene_id % 5 = 1 and role = 'after', c + 100000, c)")
    x = preprocess.preprocess(raw, _meta(spark, sf_dir).withColumn("c", away), _folder(spark, "preprocessed"), classes, _rasters(spark, sf_dir).withColumn("c", away))
    d = lambda n: F.col(f"document.{n}")
    outputs = F.array_join(F.array_distinct(F.transform(d("outputs"), lambda o: o["output"])), ",")
    none = F.lit(0)
    return x.select(
        "scene_id", "passed", F.array_join("problems", ",").alias("problems"), F.coalesce(d("grid.width"), none).cast("int").alias("width"), F.coalesce(d("cloud_mask.masked_pixels"), none).alias("masked_pixels"),
        d("ndvi.difference.mean").alias("ndvi_mean"), F.coalesce(F.array_size(d("observations")), none).alias("observations"), F.coalesce(outputs, F.lit("")).alias("outputs"),
    )


@query(with_(PIXELS, SCORED, BATCH) + f"SELECT scene_id, 'spectral' AS model, 0.7::DOUBLE AS threshold, '15,100' AS shape, count(*) FILTER (m = 1) AS change_pixels, {ratio('count(*) FILTER (m = 1)', 'count(*) FILTER (m <> 255)')} AS change_fraction, 1 AS outputs FROM m GROUP BY scene_id")
def inference_documents(spark, sf_dir):
    """Documents of a batch inference."""
    from pixelweft.operators import documents
    from pixelweft.plans.prepared import _folder

    folder = _folder(spark, "inference")
    scored, _ = analysis.infer(pixels.pairs(spark, sf_dir), threshold=0.7)
    sinks.document(documents.inference_documents(scored, _grids_of(spark, sf_dir), folder, 0.7, "spectral"), f"{folder}/summary")
    x = spark.read.json(f"{folder}/summary")
    return x.select(F.col("scene_id").cast("long").alias("scene_id"), "model", "threshold", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), "statistics.change_pixels", "statistics.change_fraction", F.size("outputs").alias("outputs"))


@query(with_(DERIVED, "best AS (SELECT *, c % 40 AS area, CASE WHEN k % 2 = 0 THEN 'before' ELSE 'after' END AS r, (k * 37) % 101 AS cloud FROM o QUALIFY row_number() OVER (PARTITION BY c % 40, k % 2 ORDER BY CASE WHEN k % 7 = 3 THEN 0 ELSE 1 END, (k * 37) % 101, 'S' || k) = 1)") + """
SELECT area AS aoi, max(CASE r WHEN 'before' THEN 'S' || k END) AS before_item, max(CASE r WHEN 'after' THEN 'S' || k END) AS after_item, max(CASE r WHEN 'before' THEN CAST(cloud AS DOUBLE) END) AS before_cloud, max(CASE r WHEN 'after' THEN CAST(d AS VARCHAR) END) AS after_date,
  CAST(10 + any_value(area) AS INTEGER) AS width, 'B02,B03' AS bands, CAST(max(CASE r WHEN 'after' THEN area + 1 END) AS BIGINT) AS after_min FROM best GROUP BY area""")
def acquisition_documents(spark, sf_dir):
    """Documents of the scenes that a catalogue search settled on, for both dates of each area."""
    from pixelweft.operators import catalog, documents

    chosen = catalog.pick(derived.scenes(spark, sf_dir), ["aoi", "role"], F.lit("T3"))
    places = chosen.select("aoi", "role")
    found = places.select("aoi", "role", F.explode(F.array(F.lit("B02"), F.lit("B03"))).alias("band")).withColumn("min_dn", F.col("aoi") + F.when(F.col("role") == "after", 1).otherwise(0))
    windows = places.select("aoi", "role", F.lit(5).alias("row0"), F.lit(9).alias("row1"), F.lit(3).alias("col0"), (F.col("aoi") + 13).cast("int").alias("col1"))
    x = documents.acquisition_documents(chosen, found, windows)
    return x.select("aoi", F.col("before.item_id").alias("before_item"), F.col("after.item_id").alias("after_item"), F.col("before.cloud_cover_percent").alias("before_cloud"), F.col("after.acquisition_date").cast("string").alias("after_date"), "before.window.width", F.array_join("after.bands.band", ",").alias("bands"), F.col("after.bands")[0]["min_dn"].cast("long").alias("after_min"))


@query(with_(PIXELS, SCORED, THREE, f"rows AS (SELECT *, {_ratios} FROM counts)", f"sums AS (SELECT {_sums}, count(*) AS n FROM counts)") + f"SELECT 'derived' AS name, n AS sample_count, 0.5::DOUBLE AS threshold, tp, {ratio('tp', 'tp + fp + fn')} AS iou, (SELECT min(iou) FROM rows) AS min_iou, (SELECT round(avg(f1), 6) FROM rows) AS mean_f1, (SELECT max(iou) FROM rows) AS max_iou FROM sums")
def evaluation_documents(spark, sf_dir):
    """The document of an evaluation."""
    from pixelweft.operators import documents
    from pixelweft.plans.prepared import _folder

    path = _folder(spark, "evaluation")
    sinks.document(documents.evaluation_document(evaluation.evaluate(*_three(spark, sf_dir)), "derived", "test", 0.5, "spectral"), path)
    return spark.read.json(path).select("dataset.name", "dataset.sample_count", "threshold", "metrics.tp", "metrics.iou", "samples.min_iou", "samples.mean_f1", "samples.max_iou")


@query(with_(PIXELS, READINGS) + f"""SELECT scene_id, role, 'I' || scene_id AS item_id, 100 AS width, 15 AS height, 'B02,B03,B04,B08' AS bands, round(avg(nullif(dn, 0) / 10000.0::DOUBLE) FILTER (band = 'B04'), 6) AS red_mean, role = 'before' AS class_band,
CASE role WHEN 'before' THEN (SELECT round(count(*) FILTER (b.scl_before = 0) / count(*)::DOUBLE, 6) FROM base b WHERE b.scene_id = readings.scene_id) ELSE 1.0::DOUBLE END AS class_no_data FROM readings GROUP BY scene_id, role""")
def observation_documents(spark, sf_dir):
    """Observations with provenance (one JSON document each, of several lines) and dimensions; the after date has no class band."""
    from pixelweft.operators import documents
    from pixelweft.plans.prepared import _folder
    from pixelweft.sources import readers

    px = pixels.pixel_store(spark, sf_dir)
    parts = [F.struct(F.lit(r).alias("role"), F.lit(b).alias("band"), F.col(f"{r[0]}_{b.lower()}").alias("x")) for r in ROLES for b in BAND_ORDER]
    readings = px.select("scene_id", "row", "col", F.explode(F.array(*parts)).alias("p")).select("scene_id", "p.role", "p.band", "row", "col", "p.x")
    scl = px.select("scene_id", F.lit("before").alias("role"), F.lit("SCL").alias("band"), "row", "col", F.col("scl_before").cast("double").alias("x"))
    grids = _grids_of(spark, sf_dir)
    meta = grids.withColumn("role", F.explode(F.array(F.lit("before"), F.lit("after")))).withColumn("band", F.explode(F.array(*(F.lit(b) for b in ("B02", "B03", "B04", "B08")))))
    folder = _folder(spark, "provenance")
    text = F.format_string('{\n  "scene_id": %d,\n  "role": "%s",\n  "item_id": "I%d",\n  "cloud_cover_percent": %d\n}\n', "scene_id", "role", "scene_id", F.col("scene_id") % 40)
    both = grids.select("scene_id", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("role"))
    sinks.texts(both.select(text.alias("value")), folder)
    given = readers.provenance(spark, folder, "scene_id long, role string, item_id string, acquisition_date date, mgrs_tile string, cloud_cover_percent double")
    x = documents.observation_summary(readings.unionByName(scl), meta, given)
    red = F.filter("bands", lambda b: b["band"] == "B04")[0]["mean"]
    return x.select("scene_id", "role", "provenance.item_id", "grid.width", "grid.height", F.array_join("bands.band", ",").alias("bands"), red.alias("red_mean"), "class_band", F.round("class_no_data_fraction", 6).alias("class_no_data"))


# --- labelled regions from an index of files

#: Regions are scenes; odd ones have the names of their files in lower case and a near infrared of half the resolution, every third has other folders, every fourth no mask.
REGIONS = """
half AS (SELECT scene_id, row // 2 AS row, col // 2 AS col, avg(dn_b_b08) AS b, avg(dn_a_b08) AS a FROM base WHERE row < 14 GROUP BY scene_id, row // 2, col // 2),
taps AS (SELECT t.scene_id, t.row, t.col, sum(h.b * w) / sum(w) AS b, sum(h.a * w) / sum(w) AS a FROM (
    SELECT scene_id, row, col, r AS hr, q AS hc, (1 - abs(r - (row / 2.0::DOUBLE - 0.25::DOUBLE))) * (1 - abs(q - (col / 2.0::DOUBLE - 0.25::DOUBLE))) AS w FROM base,
      LATERAL (VALUES (CAST(floor(row / 2.0 - 0.25) AS BIGINT)), (CAST(floor(row / 2.0 - 0.25) AS BIGINT) + 1)) x(r), LATERAL (VALUES (CAST(floor(col / 2.0 - 0.25) AS BIGINT)), (CAST(floor(col / 2.0 - 0.25) AS BIGINT) + 1)) y(q)) t
  JOIN half h ON h.scene_id = t.scene_id AND h.row = hr AND h.col = hc WHERE t.row < 14 GROUP BY t.scene_id, t.row, t.col)"""


@query(with_(PIXELS, REGIONS) + """SELECT 'R' || scene_id AS region, row, col, dn_b_b02::DOUBLE AS before_b02, dn_a_b04::DOUBLE AS after_b04,
  round(CASE WHEN scene_id % 2 = 0 THEN dn_b_b08 ELSE CASE WHEN row < 14 THEN taps.b END END::DOUBLE, 6) AS before_b08, round(CASE WHEN scene_id % 2 = 0 THEN dn_a_b08 ELSE CASE WHEN row < 14 THEN taps.a END END::DOUBLE, 6) AS after_b08,
  CASE WHEN scene_id % 4 <> 0 THEN target ELSE 0 END AS target, scene_id % 4 <> 0 AS annotated FROM base LEFT JOIN taps USING (scene_id, row, col) WHERE scene_id % 5 <> 4""")
def labelled_regions(spark, sf_dir):
    """The regions of the training split, loaded from an index of files: names in any case, the first mask, 20 m bands on the 10 m grid."""
    from pixelweft.sources import labelled

    px = durable(pixels.order_pixels(spark, sf_dir), "region_orders")  # four selections read it
    odd = F.col("scene_id") % 2 == 1
    folders = lambda n: F.when(F.col("scene_id") % 3 == 0, f"imgs_{n}").otherwise(f"imgs_{n}_rect")
    file = lambda b: F.when(odd, f"{b.lower()}.tif").otherwise(f"{b}.TIF")
    name = F.concat(F.lit("R"), F.col("scene_id").cast("string")).alias("region")
    parts = [F.struct(folders(n).alias("folder"), file(b).alias("filename"), F.col(f"dn_{r}_{b.lower()}").cast("double").alias("value")) for n, r in ((1, "b"), (2, "a")) for b in ("B02", "B03", "B04")]
    nir = [F.struct(folders(n).alias("folder"), file("B08").alias("filename"), F.col(f"dn_{r}_b08").cast("double").alias("value")) for n, r in ((1, "b"), (2, "a"))]
    mask = [F.struct(F.lit("cm").alias("folder"), F.lit("CM.png").alias("filename"), (F.col("target") * 255.0).alias("value"))]
    rows = lambda x, structs: x.select(name, "scene_id", "row", "col", F.explode(F.array(*structs)).alias("p")).select("region", "scene_id", "p.folder", "p.filename", "row", "col", "p.value")
    half = px.where(odd & (F.col("row") < 14)).groupBy("scene_id", F.expr("row div 2").alias("row"), F.expr("col div 2").alias("col")).agg(F.avg("dn_b_b08").alias("dn_b_b08"), F.avg("dn_a_b08").alias("dn_a_b08"))
    found = rows(px, parts).unionByName(rows(px.where(~odd), nir)).unionByName(rows(half, nir)).unionByName(rows(px.where("scene_id % 4 != 0"), mask))
    found = durable(found, "labelled_pixels")  # what the files of an archive would hold
    files = durable(found.select("region", "scene_id", "folder", "filename").distinct(), "labelled_files")
    coarse = odd & (F.lower("filename") == "b08.tif")
    grids = files.select("region", "folder", "filename", F.when(coarse, 20.0).otherwise(10.0).alias("a"), F.lit(500000.0).alias("c"), F.when(coarse, -20.0).otherwise(-10.0).alias("e"), F.lit(2000000.0).alias("f"), F.when(coarse, 50).otherwise(100).alias("width"), F.when(coarse, 7).otherwise(15).alias("height"))
    splits = files.select("region", "scene_id").distinct().select(F.when(F.col("scene_id") % 5 == 4, "test").otherwise("train").alias("split"), F.lower("region").alias("region")).unionByName(spark.createDataFrame([("test", "none")], "split string, region string"))
    x = labelled.load(files.drop("scene_id"), found.drop("scene_id"), grids, splits, "train")
    r6 = lambda c: F.round(F.col(c) * 10000, 6).alias(c)  # noqa: E731  (as readings again: their decimals end)
    return x.select("region", "row", "col", *(r6(c) for c in ("before_b02", "after_b04", "before_b08", "after_b08")), "target", "annotated")
