"""DuckDB SQL that says the same as ``queries``, on the same tables."""

from __future__ import annotations

#: base: readings; pw: reflectance; px: indexes, validity and change under the strict policy.
PIXELS = """
base0 AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 1500 AS scene_id, (o_orderkey % 1500) // 100 AS row, o_orderkey % 100 AS col,
         o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_line
  FROM orders),
base1 AS (SELECT *, row + col AS t, ((row // 8) * 5 + (col // 10) * 4 + scene_id) % 9 AS blk FROM base0),
base2 AS (SELECT *, k % 211 = 0 AND blk NOT IN (0, 2, 4, 6) AS iso, k % 97 = 0 AS gb, k % 89 = 0 AS ga FROM base1),
base AS (
  SELECT k, scene_id, row, col, blk,
    CASE WHEN gb THEN 0 ELSE 300 + t END AS dn_b_b02, CASE WHEN gb THEN 0 ELSE 400 + t END AS dn_b_b03,
    CASE WHEN gb THEN 0 ELSE 500 + t END AS dn_b_b04, CASE WHEN gb THEN 0 ELSE 3000 + t END AS dn_b_b08,
    CASE WHEN ga THEN 0 ELSE 300 + t + CASE WHEN blk IN (0, 2) THEN 100 ELSE 0 END END AS dn_a_b02,
    CASE WHEN ga THEN 0 ELSE 400 + t END AS dn_a_b03,
    CASE WHEN ga THEN 0 WHEN blk = 0 OR iso THEN 1200 + t WHEN blk = 2 THEN 1000 + t WHEN blk = 6 THEN 700 + t WHEN blk = 4 THEN 100 ELSE 500 + t + c % 40 END AS dn_a_b04,
    CASE WHEN ga THEN 0 WHEN blk = 0 OR iso THEN 800 + t WHEN blk = 2 THEN 2800 + t WHEN blk = 6 THEN 2700 + t WHEN blk = 4 THEN 5000 + t ELSE 3000 + t + c % 40 END AS dn_a_b08,
    CAST(CASE WHEN NOT has_line THEN 0 WHEN blk = 8 THEN 3 WHEN c % 11 = 0 THEN 5 WHEN c % 13 = 0 THEN 6 ELSE 4 END AS INTEGER) AS scl_before,
    CAST(CASE WHEN NOT has_line THEN 0 WHEN blk = 7 THEN 9 WHEN k % 83 = 0 THEN 7 WHEN blk = 0 THEN 5 WHEN blk = 2 AND c % 7 = 0 THEN 6
         WHEN c % 17 = 0 THEN 4 WHEN c % 11 = 0 THEN 5 WHEN c % 13 = 0 THEN 6 ELSE 4 END AS INTEGER) AS scl_after,
    CAST(blk IN (0, 2) AS INTEGER) AS target
  FROM base2),
pw AS (
  SELECT k, scene_id, row, col, scl_before, scl_after, target,
    nullif(dn_b_b02, 0) / 10000.0::DOUBLE AS b_b02, nullif(dn_b_b03, 0) / 10000.0::DOUBLE AS b_b03, nullif(dn_b_b04, 0) / 10000.0::DOUBLE AS b_b04, nullif(dn_b_b08, 0) / 10000.0::DOUBLE AS b_b08,
    nullif(dn_a_b02, 0) / 10000.0::DOUBLE AS a_b02, nullif(dn_a_b03, 0) / 10000.0::DOUBLE AS a_b03, nullif(dn_a_b04, 0) / 10000.0::DOUBLE AS a_b04, nullif(dn_a_b08, 0) / 10000.0::DOUBLE AS a_b08
  FROM base),
pv AS (SELECT *, b_b08 IS NOT NULL AND scl_before IN (4, 5, 6) AS valid_before, a_b08 IS NOT NULL AND scl_after IN (4, 5, 6) AS valid_after FROM pw),
pn AS (
  SELECT *, valid_before AND valid_after AS valid,
    CASE WHEN valid_before AND valid_after THEN (b_b08 - b_b04) / (b_b08 + b_b04) END AS ndvi_before,
    CASE WHEN valid_before AND valid_after THEN (a_b08 - a_b04) / (a_b08 + a_b04) END AS ndvi_after
  FROM pv),
px AS (SELECT *, ndvi_after - ndvi_before AS ndvi_diff, valid AND coalesce(ndvi_after - ndvi_before <= -0.2, false) AS change FROM pn)"""

READINGS = """
readings AS (
  SELECT scene_id, row, col, role, band, dn FROM base, LATERAL (VALUES
    ('before', 'B02', dn_b_b02), ('before', 'B03', dn_b_b03), ('before', 'B04', dn_b_b04), ('before', 'B08', dn_b_b08),
    ('after', 'B02', dn_a_b02), ('after', 'B03', dn_a_b03), ('after', 'B04', dn_a_b04), ('after', 'B08', dn_a_b08)) v(role, band, dn))"""

RUNS = """
islands AS (SELECT scene_id, row, col, col - row_number() OVER (PARTITION BY scene_id, row ORDER BY col) AS island FROM px WHERE change),
runs AS (SELECT scene_id, row, min(col) AS c0, max(col) AS c1, count(*) AS len FROM islands GROUP BY scene_id, row, island),
nodes AS (SELECT *, row * 1000 + c0 AS id FROM runs),
edges AS (SELECT a.scene_id, a.id AS x, b.id AS y FROM nodes a JOIN nodes b ON a.scene_id = b.scene_id AND a.row = b.row - 1 AND a.c0 <= b.c1 + 1 AND b.c0 <= a.c1 + 1),
both_ways AS (SELECT scene_id, x, y FROM edges UNION SELECT scene_id, y, x FROM edges),
reach AS (SELECT scene_id, id, id AS seen FROM nodes UNION SELECT r.scene_id, r.id, e.y FROM reach r JOIN both_ways e ON r.scene_id = e.scene_id AND r.seen = e.x),
labels AS (SELECT scene_id, id, min(seen) AS patch FROM reach GROUP BY scene_id, id),
sizes AS (SELECT scene_id, patch, CAST(sum(len) AS BIGINT) AS pixels FROM labels JOIN nodes USING (scene_id, id) GROUP BY scene_id, patch HAVING sum(len) >= 4),
patches AS (
  SELECT scene_id, count(*) AS patch_count, round(avg(round(pixels / 100.0::DOUBLE, 4)), 4) AS mean_patch_area_ha, max(round(pixels / 100.0::DOUBLE, 4)) AS max_patch_area_ha,
         count(*) FILTER (pixels >= 100) AS large_patch_count
  FROM sizes GROUP BY scene_id)"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6), 0.0::DOUBLE)"


def ha(n: str) -> str:
    return f"round(({n}) * 100.0::DOUBLE / 10000.0::DOUBLE, 4)"


def n_if(test: str) -> str:
    return f"count(*) FILTER ({test})"


def avg_if(x: str, test: str) -> str:
    return f"round(avg({x}) FILTER ({test}), 6)"


def with_(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",".join(parts) + "\n"


AREAS = f"""
  count(*) AS total_pixels, {n_if("valid")} AS valid_pixels, {ratio(n_if("valid"), "count(*)")} AS valid_fraction,
  {ha("count(*)")} AS total_area_ha, {ha(n_if("valid"))} AS valid_area_ha, round({ha("count(*)")} / 100.0::DOUBLE, 6) AS total_area_km2,
  {n_if("change")} AS changed_pixels, round({n_if("change")} * 100.0::DOUBLE, 2) AS changed_area_m2, {ha(n_if("change"))} AS changed_area_ha,
  round({ha(n_if("change"))} / 100.0::DOUBLE, 6) AS changed_area_km2, {ratio(n_if("change"), n_if("valid"))} AS change_fraction_of_valid"""
ZONES = f"""
  {avg_if("ndvi_before", "valid")} AS ndvi_before_mean, {avg_if("ndvi_after", "valid")} AS ndvi_after_mean, {avg_if("ndvi_diff", "valid")} AS ndvi_diff_mean,
  {avg_if("ndvi_before", "change")} AS change_ndvi_before_mean, {avg_if("ndvi_after", "change")} AS change_ndvi_after_mean, {avg_if("ndvi_diff", "change")} AS change_ndvi_diff_mean,
  round(stddev_pop(ndvi_diff) FILTER (change), 6) AS change_ndvi_diff_std"""
_veg = [("loss", "01", "ndvi_diff <= -0.1"), ("loss", "02", "ndvi_diff <= -0.2"), ("loss", "03", "ndvi_diff <= -0.3"), ("gain", "02", "ndvi_diff >= 0.2")]
VEGETATION = (
    ", ".join(f"{n_if(t)} AS veg_{w}_pixels_{n}" for w, n, t in _veg) + ", " + ", ".join(f"{ha(n_if(t))} AS veg_{w}_ha_{n}" for w, n, t in _veg)
    + f", {ratio(n_if('ndvi_diff <= -0.2'), n_if('valid'))} AS veg_loss_fraction"
)
DELTAS = ", ".join(avg_if(f"a_{b} - b_{b}", "change") + f" AS delta_{b}_mean" for b in ("b02", "b03", "b04", "b08")) + ", " + avg_if("(a_b02 + a_b03 + a_b04) / 3 - (b_b02 + b_b03 + b_b04) / 3", "change") + " AS brightness_diff_mean"
_move = lambda a, b: n_if(f"scl_before = {a} AND scl_after = {b} AND change")
TRANSITIONS = f"""
  {_move(4, 5)} AS scl_veg_to_nonveg_pixels, {_move(4, 6)} AS scl_veg_to_water_pixels, {_move(6, 5)} AS scl_water_to_nonveg_pixels,
  {_move(5, 4)} AS scl_nonveg_to_veg_pixels, {ha(_move(4, 5) + " + " + _move(4, 6))} AS scl_veg_loss_ha"""
FEATURES = f"""
feats AS (
  SELECT f.*, CAST(coalesce(patch_count, 0) AS BIGINT) AS patch_count, coalesce(mean_patch_area_ha, 0.0::DOUBLE) AS mean_patch_area_ha,
    coalesce(max_patch_area_ha, 0.0::DOUBLE) AS max_patch_area_ha, CAST(coalesce(large_patch_count, 0) AS BIGINT) AS large_patch_count,
    f.valid_pixels * 100.0::DOUBLE / 1000000.0::DOUBLE AS valid_area_km2,
    CASE WHEN f.valid_pixels > 0 THEN round(coalesce(patch_count, 0) / (f.valid_pixels * 100.0::DOUBLE / 1000000.0::DOUBLE), 4) ELSE 0.0::DOUBLE END AS patch_density_per_km2
  FROM (SELECT scene_id, {AREAS}, {ZONES}, {VEGETATION}, {DELTAS}, {TRANSITIONS} FROM px GROUP BY scene_id) f LEFT JOIN patches USING (scene_id))"""
RULE = """
scored_rows AS (
  SELECT *, round(round(least(100.0::DOUBLE, least(25.0::DOUBLE, veg_loss_ha_02 * 2.5::DOUBLE) + least(15.0::DOUBLE, veg_loss_ha_03 * 5.0::DOUBLE) + least(25.0::DOUBLE, scl_veg_loss_ha * 5.0::DOUBLE)
      + least(12.0::DOUBLE, large_patch_count * 4.0::DOUBLE) + least(8.0::DOUBLE, max_patch_area_ha * 1.5::DOUBLE) + least(15.0::DOUBLE, (change_fraction_of_valid + veg_loss_fraction) * 50.0::DOUBLE)), 9), 2) AS composite_score,
    veg_loss_ha_02 >= 10 OR scl_veg_loss_ha >= 5 OR (large_patch_count >= 3 AND changed_area_ha >= 8) AS hard
  FROM feats),
ruled AS (
  SELECT *, CASE WHEN hard THEN 'critical_deforestation_scale' END AS hard_override,
    CASE WHEN hard OR composite_score >= 55 THEN 'HIGH' WHEN composite_score >= 22 OR veg_loss_ha_02 >= 2 OR (changed_area_ha >= 3 AND large_patch_count >= 1) THEN 'MEDIUM' ELSE 'LOW' END AS priority_label
  FROM scored_rows)"""
REASONS = {"no_data": "0", "saturated_or_defective": "1", "shadow": "2, 3", "unclassified": "7", "cloud": "8, 9", "cirrus": "10", "snow_or_ice": "11"}
NAMES = "CASE class WHEN 0 THEN 'no_data' WHEN 1 THEN 'saturated_or_defective' WHEN 2 THEN 'dark_area_or_cast_shadow' WHEN 3 THEN 'cloud_shadow' WHEN 4 THEN 'vegetation' WHEN 5 THEN 'not_vegetated' WHEN 6 THEN 'water' WHEN 7 THEN 'unclassified' WHEN 8 THEN 'cloud_medium_probability' WHEN 9 THEN 'cloud_high_probability' WHEN 10 THEN 'thin_cirrus' WHEN 11 THEN 'snow_or_ice' ELSE 'unknown_class_' || class END"
SCORED = """
scored AS (
  SELECT *, CASE WHEN valid THEN 1 / (1 + exp(-(20.0::DOUBLE * (abs(ndvi_diff) - 0.2::DOUBLE)))) END AS change_prob FROM px),
masks AS (SELECT *, CASE WHEN change_prob IS NULL THEN 255 WHEN change_prob > 0.5 THEN 1 ELSE 0 END AS change_mask FROM scored)"""

#: The 25 features of the vector as rows (scene_id, feature, x).
def feature_select() -> str:
    from pixelweft.schemas import FEATURE_NAMES

    return ", ".join(f"coalesce(CAST({n} AS DOUBLE), 0.0::DOUBLE) AS {n}" for n in FEATURE_NAMES)


def oracles() -> dict[str, str]:
    from pixelweft.plans import prepared

    p = with_(PIXELS)
    feats = with_(PIXELS, RUNS, FEATURES, recursive=True)
    areas = ", ".join(f"{n_if(f'ndvi_diff {op} {s}{t}')} AS {w}_{g}_pixels, {ratio(n_if(f'ndvi_diff {op} {s}{t}'), 'count(ndvi_diff)')} AS {w}_{g}_fraction" for t, g in ((0.1, "01"), (0.2, "02"), (0.3, "03")) for w, op, s in (("loss", "<=", "-"), ("gain", ">=", "")))
    hist = with_(PIXELS) + f"""SELECT scene_id, role, class, CASE WHEN class IS NULL THEN 'non_finite' ELSE {NAMES} END AS name, pixels,
      {ratio('pixels', 'sum(pixels) OVER (PARTITION BY scene_id, role)')} AS fraction, class IN (4, 5, 6) AS usable
      FROM (SELECT scene_id, role, class, count(*) AS pixels FROM (SELECT scene_id, 'before' AS role, scl_before AS class FROM px UNION ALL SELECT scene_id, 'after', scl_after FROM px) GROUP BY ALL)"""
    reasons = ", ".join(f"{n_if(f'scl IN ({codes})')} AS {name}_pixels" for name, codes in REASONS.items())
    sides = "(SELECT scene_id, 'before' AS role, scl_before AS scl FROM px UNION ALL SELECT scene_id, 'after', scl_after FROM px)"
    conf = """tp AS (SELECT scene_id, count(*) FILTER (m = 1 AND target = 1) AS tp, count(*) FILTER (m = 1 AND target = 0) AS fp, count(*) FILTER (m = 0 AND target = 1) AS fn, count(*) FILTER (m = 0 AND target = 0) AS tn
      FROM (SELECT scene_id, target, change_mask AS m FROM masks WHERE change_mask <> 255) GROUP BY scene_id)"""
    return {
        "ndvi_change_areas": p + f"SELECT scene_id, count(ndvi_diff) AS valid_pixels, {areas} FROM px GROUP BY scene_id",
        "ndvi_pixels": p + "SELECT scene_id, row, col, round(ndvi_before, 9) AS ndvi_before, round(ndvi_after, 9) AS ndvi_after, round(ndvi_diff, 9) AS ndvi_diff, valid FROM px",
        "ndvi_describe": p + f"SELECT scene_id, count(ndvi_diff) AS valid_pixels, count(*) - count(ndvi_diff) AS invalid_pixels, {ratio('count(ndvi_diff)', 'count(*)')} AS valid_fraction, round(min(ndvi_diff), 6) AS min, round(max(ndvi_diff), 6) AS max, round(avg(ndvi_diff), 6) AS mean, round(stddev_pop(ndvi_diff), 6) AS std, round(median(ndvi_diff), 6) AS median FROM px GROUP BY scene_id",
        "observation_summary": with_(PIXELS, READINGS) + f"SELECT scene_id, role, band, count(x) AS valid_pixels, count(*) - count(x) AS invalid_pixels, {ratio('count(x)', 'count(*)')} AS valid_fraction, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(median(x), 6) AS median FROM (SELECT *, nullif(dn, 0) / 10000.0::DOUBLE AS x FROM readings) GROUP BY ALL",
        "pair_from_readings": with_(PIXELS) + "SELECT scene_id, row, col, b_b02, b_b03, b_b04, b_b08, a_b02, a_b03, a_b04, a_b08 FROM pw",
        "raw_band_stats": with_(PIXELS, READINGS) + "SELECT scene_id, role, band, count(*) FILTER (dn <> 0) AS valid_pixels, CAST(min(dn) FILTER (dn <> 0) AS INTEGER) AS min_dn, CAST(max(dn) FILTER (dn <> 0) AS INTEGER) AS max_dn, round(avg(dn) FILTER (dn <> 0), 3) AS mean_dn FROM readings GROUP BY ALL",
        "scl_histogram": hist,
        "scl_mask_report": p + f"SELECT scene_id, role, count(*) AS pixels, {n_if('scl IN (4, 5, 6)')} AS usable_pixels, count(*) - {n_if('scl IN (4, 5, 6)')} AS masked_pixels, {ratio(n_if('scl IN (4, 5, 6)'), 'count(*)')} AS usable_fraction, {ratio('count(*) - ' + n_if('scl IN (4, 5, 6)'), 'count(*)')} AS masked_fraction, {reasons} FROM {sides} GROUP BY ALL",
        "pair_valid_fraction": p + f"SELECT scene_id, {n_if('valid_before')} AS before_pixels, {n_if('valid_after')} AS after_pixels, {n_if('valid')} AS shared_pixels, {ratio(n_if('valid'), 'count(*)')} AS shared_fraction FROM px GROUP BY scene_id",
        "lenient_vs_strict": p + f"SELECT scene_id, {n_if('valid')} AS strict_pixels, {n_if('b_b08 IS NOT NULL AND a_b08 IS NOT NULL AND scl_before IN (4,5,6,7) AND scl_after IN (4,5,6,7)')} AS lenient_pixels FROM px GROUP BY scene_id",
        "area_accounting": p + f"SELECT scene_id, {AREAS} FROM px GROUP BY scene_id",
        "change_zone_stats": p + f"SELECT scene_id, {ZONES} FROM px GROUP BY scene_id",
        "veg_thresholds": p + f"SELECT scene_id, {VEGETATION} FROM px GROUP BY scene_id",
        "band_deltas": p + f"SELECT scene_id, {DELTAS} FROM px GROUP BY scene_id",
        "scl_transitions": p + f"SELECT scene_id, {TRANSITIONS} FROM px GROUP BY scene_id",
        "transition_matrix": p + "SELECT scene_id, scl_before, scl_after, count(*) AS pixels FROM px WHERE change GROUP BY ALL",
        "change_runs": with_(PIXELS, RUNS, recursive=True) + "SELECT scene_id, row, c0, c1, len FROM runs",
        "patch_sizes": with_(PIXELS, RUNS, recursive=True) + "SELECT scene_id, pixels, round(pixels / 100.0::DOUBLE, 4) AS area_ha FROM sizes",
        "patch_stats": with_(PIXELS, RUNS, recursive=True) + "SELECT scene_id, patch_count, mean_patch_area_ha, max_patch_area_ha, large_patch_count FROM patches",
        "feature_rows": feats + "SELECT * FROM feats",
        "feature_vector": feats + f"SELECT scene_id, {feature_select()} FROM feats",
        "rule_priority": with_(PIXELS, RUNS, FEATURES, RULE, recursive=True) + "SELECT scene_id, composite_score, hard_override, priority_label, CASE priority_label WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS priority_int, 'rule_derived_prototype' AS label_source FROM ruled",
        "class_counts": with_(PIXELS, RUNS, FEATURES, RULE, recursive=True) + "SELECT l AS priority_label, count(priority_label) AS n FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) v(l) LEFT JOIN ruled ON l = priority_label GROUP BY l",
        "summary_rows": feats + "SELECT scene_id, CAST(position AS INTEGER) AS position, name, value FROM feats, LATERAL (VALUES " + ", ".join(f"({i}, '{n}', {'25.0::DOUBLE' if n == 'feature_vector_length' else f'CAST({n} AS DOUBLE)'})" for i, n in enumerate(SUMMARY)) + ") v(position, name, value)",
        "change_mask": with_(PIXELS, SCORED) + "SELECT scene_id, row, col, round(change_prob, 9) AS change_prob, CAST(change_mask AS INTEGER) AS change_mask FROM masks",
        "inference_stats": with_(PIXELS, SCORED) + f"SELECT scene_id, count(*) AS total_pixels, {n_if('change_mask <> 255')} AS valid_pixels, {n_if('change_mask = 255')} AS masked_pixels, {n_if('change_mask = 1')} AS change_pixels, {n_if('change_mask = 0')} AS no_change_pixels, {ratio(n_if('change_mask = 1'), n_if('change_mask <> 255'))} AS change_fraction, round({n_if('change_mask = 1')} * 100.0::DOUBLE / 10000.0::DOUBLE, 2) AS change_area_ha, round({n_if('change_mask = 1')} * 100.0::DOUBLE / 1000000.0::DOUBLE, 4) AS change_area_km2 FROM masks GROUP BY scene_id",
        "confusion_metrics": with_(PIXELS, SCORED, conf) + f"SELECT scene_id, tp, fp, fn, tn, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {ratio('tp', 'tp + fp + fn')} AS iou, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM tp",
        "bce_dice": with_(PIXELS, SCORED) + """SELECT scene_id, round(avg(greatest(x, 0) - x * target + ln(1 + exp(-abs(x)))), 6) AS bce,
            round(1 - (2 * sum(change_prob * target) + 1.0::DOUBLE) / (sum(change_prob) + sum(target) + 1.0::DOUBLE), 6) AS dice_loss
            FROM (SELECT scene_id, CAST(target AS DOUBLE) AS target, change_prob, 20.0::DOUBLE * (abs(ndvi_diff) - 0.2::DOUBLE) AS x FROM masks WHERE change_prob IS NOT NULL) GROUP BY scene_id""",
        "target_fractions": p + "SELECT scene_id, round(avg(target), 6) AS change_fraction FROM px GROUP BY scene_id",
    } | derived_oracles() | prepared.ORACLES


DERIVED = """
o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderstatus AS status, o_totalprice AS price FROM orders),
r0 AS (SELECT *, 70 + (k % 50) / 10.0::DOUBLE AS min_lon, 18 + (k % 30) / 10.0::DOUBLE AS min_lat FROM o),
requests AS (
  SELECT k, 'run-' || k AS analysis_id, min_lon, min_lon + (CASE WHEN k % 17 = 0 THEN -1 ELSE 2 END) / 10.0::DOUBLE AS max_lon, min_lat, min_lat + (CASE WHEN k % 19 = 0 THEN -1 ELSE 1 END) / 10.0::DOUBLE AS max_lat,
    d AS before_date, CAST(d + CAST(CASE WHEN k % 23 = 0 THEN 0 ELSE 30 + k % 100 END AS INTEGER) AS DATE) AS after_date, (k % 13) / 10.0::DOUBLE AS threshold,
    CASE WHEN k % 29 = 0 THEN 'loose' WHEN k % 2 = 0 THEN 'strict' ELSE 'lenient' END AS policy, CASE WHEN k % 31 = 0 THEN 0 ELSE 10 END AS res FROM r0),
scenes AS (SELECT k, 'S' || k AS item_id, c % 40 AS aoi, CASE WHEN k % 2 = 0 THEN 'before' ELSE 'after' END AS role, ts, CAST((k * 37) % 101 AS DOUBLE) AS cloud_cover_percent, 'T' || (k % 7) AS tile, c % 90 AS x0, c % 45 AS y0 FROM o),
parts AS (SELECT 'tile_' || k AS stem, p AS part FROM o, LATERAL (VALUES ('A', k % 5 <> 0), ('B', k % 7 <> 0), ('label', k % 11 <> 0)) v(p, here) WHERE here),
splits AS (SELECT DISTINCT CASE WHEN status = 'F' THEN 'train' ELSE 'test' END AS split, 'r' || (c % 500) AS region FROM o),
runs AS (SELECT k, 'run-' || k AS analysis_id, ts AS created_at, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN k % 5 <> 0 THEN CASE k % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END END AS priority, CASE WHEN k % 5 <> 0 THEN (k % 100) / 100.0::DOUBLE END AS confidence, CASE WHEN k % 5 <> 0 THEN (k % 977) / 10.0::DOUBLE END AS changed_area_ha FROM o),
yp AS (SELECT CAST(k % 3 AS INTEGER) AS y, CAST((CASE WHEN k % 7 = 0 THEN k + 1 ELSE k END) % 3 AS INTEGER) AS p FROM o)"""


def derived_oracles() -> dict[str, str]:
    w = with_(DERIVED)
    bands = ("B02", "B03", "B04", "B08")
    band_list = [f"('band_readable_{b}', true)" for b in bands]
    band_list += [f"('band_has_variation_{b}', bool_or(band = '{b}' AND usable > 0 AND sd > 0))" for b in bands]
    band_list += [f"('band_values_in_sensor_range_{b}', bool_or(band = '{b}' AND lo >= 0 AND hi <= 65535))" for b in bands]
    band_list += ["('bands_present', count(DISTINCT band) = 4)", "('no_non_finite_pixels', true)", "('has_valid_pixels', min(usable::DOUBLE / n) > 0)", "('mostly_valid_pixels', min(round(usable::DOUBLE / n, 6)) >= 0.99)"]
    columns = ", ".join(f"{v.split(', ', 1)[1][:-1]} AS x{i}" for i, v in enumerate(band_list))
    values = ", ".join(f"({v.split(', ', 1)[0][1:]}, x{i})" for i, v in enumerate(band_list))
    processed = ["shared_is_before_and_after", "reflectance_in_range", "ndvi_in_range", "ndvi_difference_in_range", "mostly_valid", "valid_has_usable_class", "usable_in_both", "classes_known"]
    tests = ["true", "true", "bool_and(coalesce(ndvi_before BETWEEN -1 AND 1, true) AND coalesce(ndvi_after BETWEEN -1 AND 1, true))", "bool_and(coalesce(ndvi_diff BETWEEN -2 AND 2, true))", "count(*) FILTER (valid) / count(*)::DOUBLE > 0.99",
             "bool_and(NOT valid OR (scl_before IN (4, 5, 6) AND scl_after IN (4, 5, 6)))", "count(*) FILTER (valid) / count(*)::DOUBLE >= 0.5", "bool_and(scl_before BETWEEN 0 AND 11 AND scl_after BETWEEN 0 AND 11)"]
    checks = f"""checks AS (SELECT scene_id, c AS "check", passed FROM (SELECT scene_id, {", ".join(f"{t} AS x{i}" for i, t in enumerate(tests))} FROM px GROUP BY scene_id), LATERAL (VALUES {", ".join(f"('{n}', x{i})" for i, n in enumerate(processed))}) v(c, passed))"""
    problems = [("longitude out of range", "NOT (min_lon BETWEEN -180 AND 180 AND max_lon BETWEEN -180 AND 180)"), ("latitude out of range", "NOT (min_lat BETWEEN -90 AND 90 AND max_lat BETWEEN -90 AND 90)"),
                ("min_lon must be less than max_lon", "min_lon >= max_lon"), ("min_lat must be less than max_lat", "min_lat >= max_lat"), ("before_date must precede after_date", "before_date >= after_date"),
                ("change_threshold must lie in [0, 1]", "NOT (threshold BETWEEN 0 AND 1)"), ("unknown scl_policy", "policy NOT IN ('strict', 'lenient')"), ("pixel_resolution_m must be positive", "res <= 0")]
    texts = ", ".join(f"CASE WHEN {t} THEN '{m}' END" for m, t in problems)
    red = "red AS (SELECT scene_id, row, col, nullif(dn_b_b04, 0) AS v FROM base)"
    tap = lambda i, dr, dc: f"LEFT JOIN red r{i} ON r{i}.scene_id = t.scene_id AND r{i}.row = t.row + {dr} AND r{i}.col = t.col + {dc}"
    weights = [(0, 0, 0.42), (0, 1, 0.18), (1, 0, 0.28), (1, 1, 0.12)]
    num = " + ".join(f"coalesce(r{i}.v * {x}::DOUBLE, 0)" for i, (_, _, x) in enumerate(weights))
    den = " + ".join(f"CASE WHEN r{i}.v IS NULL THEN 0 ELSE {x}::DOUBLE END" for i, (_, _, x) in enumerate(weights))
    bilinear = f"SELECT t.scene_id, CAST(t.row AS INTEGER) AS row, CAST(t.col AS INTEGER) AS col, CASE WHEN t.v IS NOT NULL THEN round(({num}) / ({den}), 6) END AS dn FROM red t " + " ".join(tap(i, r, c) for i, (r, c, _) in enumerate(weights))
    cellsql = lambda h, n: f"cells AS (SELECT scene_id, CAST(r AS INTEGER) AS row, CAST(q AS INTEGER) AS col FROM (SELECT DISTINCT scene_id FROM base), range({h}) a(r), range({n}) b(q))"
    f1 = [f"coalesce(2.0 * tp{k} / nullif(y{k} + p{k}, 0), 0.0::DOUBLE)" for k in range(3)]
    sums = ", ".join(f"CAST(count(*) FILTER (y = {k} AND p = {k}) AS DOUBLE) AS tp{k}, CAST(count(*) FILTER (y = {k}) AS DOUBLE) AS y{k}, CAST(count(*) FILTER (p = {k}) AS DOUBLE) AS p{k}" for k in range(3))
    chance = " + ".join(f"(y{k} / n) * (p{k} / n)" for k in range(3))
    share = lambda f: f"greatest(1, round(n * {f}::DOUBLE))"
    return {
        "band_validation": with_(PIXELS, READINGS) + f"""SELECT scene_id, role, c AS "check", passed FROM (SELECT scene_id, role, {columns} FROM (SELECT scene_id, role, band, count(*) AS n, count(*) FILTER (dn <> 0) AS usable, stddev_pop(dn) FILTER (dn <> 0) AS sd, min(dn) FILTER (dn <> 0) AS lo, max(dn) FILTER (dn <> 0) AS hi FROM readings GROUP BY ALL) GROUP BY scene_id, role), LATERAL (VALUES {values}) v(c, passed)""",
        "processed_validation": with_(PIXELS, checks) + 'SELECT scene_id, "check", passed FROM checks',
        "validation_report": with_(PIXELS, checks) + """SELECT scene_id, bool_and(passed) AS passed, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (NOT passed), '') AS problems FROM checks GROUP BY scene_id""",
        "class_checks": with_(PIXELS) + """SELECT scene_id, role, c AS "check", passed FROM (SELECT scene_id, role, count(scl) > 0 AS a, count(*) FILTER (scl NOT BETWEEN 0 AND 11) = 0 AS b, count(*) FILTER (scl IN (4, 5, 6)) > 0 AS u FROM (SELECT scene_id, 'before' AS role, scl_before AS scl FROM base UNION ALL SELECT scene_id, 'after', scl_after FROM base) GROUP BY ALL), LATERAL (VALUES ('scl_present', a), ('scl_classes_known', b), ('scl_has_usable_pixels', u)) v(c, passed)""",
        "missing_bands": with_(PIXELS) + "SELECT DISTINCT scene_id, 'after' AS role, 'B08' AS band FROM base WHERE scene_id % 3 = 1",
        "request_checks": w + f"SELECT analysis_id, len(p) = 0 AS accepted, array_to_string(p, '; ') AS problems FROM (SELECT analysis_id, list_filter([{texts}], lambda x: x IS NOT NULL) AS p FROM requests)",
        "scene_search": w + "SELECT item_id, cloud_cover_percent, tile FROM scenes WHERE ts BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-12-31' AND cloud_cover_percent < 40 AND k % 9 <> 0 AND x0 <= 40 AND x0 + 10 >= 20 AND y0 <= 30 AND y0 + 10 >= 10",
        "scene_pick": w + """, b AS (SELECT * FROM scenes WHERE role = 'before' QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY tile <> 'T3', cloud_cover_percent, item_id) = 1),
          a AS (SELECT s.* FROM scenes s JOIN b USING (aoi) WHERE s.role = 'after' QUALIFY row_number() OVER (PARTITION BY s.aoi ORDER BY s.tile <> b.tile, s.cloud_cover_percent, s.item_id) = 1)
          SELECT aoi, role, item_id, tile, cloud_cover_percent FROM b UNION ALL SELECT aoi, role, item_id, tile, cloud_cover_percent FROM a""",
        "common_grid": with_(PIXELS) + """, s AS (SELECT DISTINCT scene_id FROM base), g AS (SELECT scene_id, greatest(500000 + 10 * (scene_id % 7), 500050) AS x0, least(501000 + 10 * (scene_id % 7), 501050) AS x1, least(2000000, 1999970 - 3 * (scene_id % 5)) AS y1, greatest(1999850, 1999820 - 3 * (scene_id % 5)) AS y0 FROM s),
          q AS (SELECT scene_id, floor(x0 / 10.0) * 10 AS x0, ceil(x1 / 10.0) * 10 AS x1, floor(y0 / 10.0) * 10 AS y0, ceil(y1 / 10.0) * 10 AS y1 FROM g)
          SELECT scene_id, 'EPSG:32643' AS crs, 10.0::DOUBLE AS a, CAST(x0 AS DOUBLE) AS c, -10.0::DOUBLE AS e, CAST(y1 AS DOUBLE) AS f, CAST((x1 - x0) / 10 AS INTEGER) AS width, CAST((y1 - y0) / 10 AS INTEGER) AS height FROM q""",
        "bounds_checks": with_(PIXELS) + """, s AS (SELECT DISTINCT scene_id FROM base), g AS (SELECT scene_id, CAST(greatest(0, least(501000 + 10 * (scene_id % 7), 501050) - greatest(500000 + 10 * (scene_id % 7), 500050)) * greatest(0, least(2000000, 1999970 - 3 * (scene_id % 5)) - greatest(1999850, 1999820 - 3 * (scene_id % 5))) AS DOUBLE) AS area FROM s)
          SELECT scene_id, round(area / 1e6::DOUBLE, 3) AS overlap_km2, round(area / 150000.0::DOUBLE, 6) AS overlap_fraction, area > 0 AS bounds_overlap, area / 150000.0::DOUBLE >= 0.25 AS overlap_covers_smaller_footprint FROM g""",
        "resample_bilinear": with_(PIXELS, red) + bilinear,
        "resample_nearest": with_(PIXELS, red, cellsql(15, 100)) + "SELECT c.scene_id, c.row, c.col, round(CAST(r.v AS DOUBLE), 6) AS dn FROM cells c LEFT JOIN red r ON r.scene_id = c.scene_id AND r.row = c.row + 3 AND r.col = c.col + 5",
        "resample_average": with_(PIXELS, red, cellsql(8, 50)) + "SELECT c.scene_id, c.row, c.col, CASE WHEN max(CASE WHEN r.row % 2 = 1 AND r.col % 2 = 1 THEN r.v END) IS NOT NULL THEN round(avg(r.v), 6) END AS dn FROM cells c LEFT JOIN red r ON r.scene_id = c.scene_id AND r.row // 2 = c.row AND r.col // 2 = c.col GROUP BY ALL",
        "paired_stems": w + "SELECT stem FROM parts GROUP BY stem HAVING count(*) = 3",
        "orphans": w + "SELECT stem, part FROM parts WHERE stem NOT IN (SELECT stem FROM parts GROUP BY stem HAVING count(*) = 3)",
        "split_leakage": w + "SELECT region FROM splits WHERE split = 'train' INTERSECT SELECT region FROM splits WHERE split = 'test'",
        "unresolved_regions": w + "SELECT DISTINCT region FROM splits WHERE region NOT IN (SELECT 'r' || (k % 400) FROM o)",
        "stratified_split": w + f"SELECT k, status, CASE WHEN r <= {share(0.2)} THEN 'test' WHEN r <= {share(0.2)} + {share(0.2)} THEN 'val' ELSE 'train' END AS split FROM (SELECT k, status, row_number() OVER (PARTITION BY status ORDER BY k * 7919 % 10007, k) AS r, count(*) OVER (PARTITION BY status) AS n FROM o)",
        "region_split": w + ", g AS (SELECT DISTINCT c % 25 AS region FROM o), v AS (SELECT region FROM g ORDER BY region * 7919 % 10007, region LIMIT (SELECT greatest(1, CAST(round_even(0.2 * count(*), 0) AS BIGINT)) FROM g)) SELECT k, c % 25 AS region, CASE WHEN c % 25 IN (SELECT region FROM v) THEN 'val' ELSE 'train' END AS split FROM o",
        "best_epoch": w + "SELECT run, epoch, iou FROM (SELECT c % 20 AS run, k AS epoch, (k * 31 % 1000) / 1000.0::DOUBLE AS iou FROM o) QUALIFY row_number() OVER (PARTITION BY run ORDER BY iou DESC, epoch) = 1",
        "dataset_union": w + "SELECT CASE status WHEN 'F' THEN 'primary' ELSE 'secondary' END AS dataset, count(*) AS n, min(k) AS first_k, max(k) AS last_k FROM o WHERE status IN ('F', 'O') GROUP BY 1",
        "dataset_summary": with_(PIXELS) + "SELECT dataset, count(*) AS samples, round(min(f), 6) AS min_fraction, round(avg(f), 6) AS mean_fraction, round(max(f), 6) AS max_fraction FROM (SELECT scene_id % 3 AS dataset, scene_id, round(avg(target), 6) AS f FROM base GROUP BY ALL) GROUP BY dataset",
        "multiclass_metrics": w + f"""SELECT n, round(hits / n, 6) AS accuracy, round(({" + ".join(f"coalesce(tp{k} / nullif(p{k}, 0), 0.0::DOUBLE)" for k in range(3))}) / 3, 6) AS macro_precision, round(({" + ".join(f"coalesce(tp{k} / nullif(y{k}, 0), 0.0::DOUBLE)" for k in range(3))}) / 3, 6) AS macro_recall,
            round(({" + ".join(f1)}) / 3, 6) AS macro_f1, round({f1[0]}, 6) AS f1_low, round({f1[1]}, 6) AS f1_medium, round({f1[2]}, 6) AS f1_high, round((hits / n - ({chance})) / (1 - ({chance})), 6) AS cohen_kappa
            FROM (SELECT count(*) AS n, CAST(count(*) FILTER (y = p) AS DOUBLE) AS hits, {sums} FROM yp)""",
        "multiclass_confusion": w + "SELECT CAST(a AS INTEGER) AS actual, CAST(b AS INTEGER) AS predicted, (SELECT count(*) FROM yp WHERE y = a AND p = b) AS n FROM range(3) x(a), range(3) z(b)",
        "history_rows": w + "SELECT analysis_id, created_at, status, priority, confidence, changed_area_ha FROM runs",
        "history_page": w + "SELECT analysis_id, created_at, status, priority, confidence, changed_area_ha FROM runs ORDER BY created_at DESC, analysis_id DESC LIMIT 20 OFFSET 20",
        "aoi_boxes": w + """, b AS (SELECT analysis_id, min_lon, min_lat, max_lon, max_lat, CAST(round(min_lon, 1) AS VARCHAR) AS a, CAST(round(min_lat, 1) AS VARCHAR) AS s, CAST(round(max_lon, 1) AS VARCHAR) AS e, CAST(round(max_lat, 1) AS VARCHAR) AS n FROM requests)
          SELECT analysis_id, abs(round((max_lon - min_lon) * 111.32::DOUBLE * cos(radians((min_lat + max_lat) / 2)) * ((max_lat - min_lat) * 110.574::DOUBLE), 4)) AS area_km2, 'POLYGON((' || a || ' ' || s || ', ' || e || ' ' || s || ', ' || e || ' ' || n || ', ' || a || ' ' || n || ', ' || a || ' ' || s || '))' AS wkt FROM b""",
        "run_states": w + "SELECT analysis_id, CASE WHEN k % 10 = 3 THEN 'no_data' WHEN k % 6 = 5 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN k % 10 <> 3 AND k % 6 = 5 THEN 'failed checks: bands_present' END AS error FROM requests",
    }



SUMMARY = [
    "total_area_ha", "valid_area_ha", "total_area_km2", "valid_area_km2", "scl_veg_loss_ha", "feature_vector_length",
    "ndvi_before_mean", "ndvi_after_mean", "ndvi_diff_mean", "change_ndvi_diff_mean", "veg_loss_ha_01", "veg_loss_ha_02", "veg_loss_ha_03", "veg_gain_ha_02", "veg_loss_fraction",
    "patch_count", "mean_patch_area_ha", "max_patch_area_ha", "patch_density_per_km2", "large_patch_count",
]
