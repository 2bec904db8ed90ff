"""Registered queries on rasters in two reference systems and on footprints, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.operators import catalog, grid, resample
from pixelweft.plans import derived
from pixelweft.plans.oracles import DERIVED, PIXELS, with_
from pixelweft.plans.prepared import _utm_sql, query
from pixelweft.sources import pixels

#: A lon/lat grid of a little over 10 m over the scenes: first longitude and step, first latitude and step down.
LON0, LON_STEP, LAT0, LAT_STEP = 75.00001, 0.0000946, 18.08811, 0.0000905


def _lonlat_sql(x: str, y: str, zone: int, cells: str) -> str:
    """SQL of the rows of ``cells`` with lon and lat: the inverse of the transverse Mercator by its series, with the constants of the grid module."""
    scale = grid.K0 * grid.RADIUS
    xi1 = "xi - (" + " + ".join(f"{b!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(grid.BETA, 1)) + ")"
    eta1 = "eta - (" + " + ".join(f"{b!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(grid.BETA, 1)) + ")"
    lat = "chi + " + " + ".join(f"{d!r}::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(grid.DELTA, 1))
    return f"""(SELECT *, degrees(atan2(sinh(eta1), cos(xi1))) + {zone * 6 - 183} AS lon, degrees({lat}) AS lat FROM
      (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM (SELECT *, {xi1} AS xi1, {eta1} AS eta1 FROM
      (SELECT *, {y} / {scale!r}::DOUBLE AS xi, ({x} - {grid.FALSE_EASTING}::DOUBLE) / {scale!r}::DOUBLE AS eta FROM {cells}))))"""


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.order_pixels(spark, sf_dir).select("scene_id").distinct()


def lonlat_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir).selectExpr("scene_id", "'EPSG:4326' as crs", f"{LON_STEP}D as a", "0.0D as b", f"{LON0}D as c", "0.0D as d", f"-{LAT_STEP}D as e", f"{LAT0}D as f", "100 as width", "15 as height")


def utm_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir).selectExpr("scene_id", "'EPSG:32643' as crs", "10.0D as a", "0.0D as b", "500003.0D + 4 * (scene_id % 7) as c", "0.0D as d", "-10.0D as e", "2000041.0D as f", "100 as width", "18 as height")


SCENES = "s AS (SELECT DISTINCT scene_id FROM base)"
_edge = f"""e AS (SELECT unnest(range(0, 22)) / 21.0::DOUBLE AS s),
pts AS (SELECT {LON0}::DOUBLE + {100 * LON_STEP!r}::DOUBLE * s AS lon, {LAT0}::DOUBLE AS lat FROM e UNION ALL SELECT {LON0}::DOUBLE + {100 * LON_STEP!r}::DOUBLE * s, {LAT0}::DOUBLE - {15 * LAT_STEP!r}::DOUBLE FROM e
  UNION ALL SELECT {LON0}::DOUBLE, {LAT0}::DOUBLE - {15 * LAT_STEP!r}::DOUBLE * s FROM e UNION ALL SELECT {LON0}::DOUBLE + {100 * LON_STEP!r}::DOUBLE, {LAT0}::DOUBLE - {15 * LAT_STEP!r}::DOUBLE * s FROM e)"""
GRIDS = f"""{SCENES}, {_edge},
moved AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {_utm_sql('lon', 'lat', 43)}),
shared AS (SELECT scene_id, greatest(500003 + 4 * (scene_id % 7), x0) AS x0, greatest(2000041 - 180, y0) AS y0, least(501003 + 4 * (scene_id % 7), x1) AS x1, least(2000041, y1) AS y1 FROM s, moved),
grids AS (SELECT scene_id, floor(round(x0 / 10, 6)) * 10 AS c, ceil(round(y1 / 10, 6)) * 10 AS f, CAST(ceil(round(x1 / 10, 6)) - floor(round(x0 / 10, 6)) AS INTEGER) AS width, CAST(ceil(round(y1 / 10, 6)) - floor(round(y0 / 10, 6)) AS INTEGER) AS height FROM shared)"""


@query(with_(PIXELS, GRIDS) + "SELECT scene_id, 'EPSG:32643' AS crs, c, f, width, height FROM grids")
def warped_grid(spark, sf_dir):
    """The grid that a date in UTM and a date in lon/lat share: in the system of the before date, at its resolution."""
    both = utm_grids(spark, sf_dir).withColumn("role", F.lit("before")).unionByName(lonlat_grids(spark, sf_dir).withColumn("role", F.lit("after")))
    return grid.common_grid(both, ["scene_id"]).select("scene_id", "crs", "c", "f", "width", "height")


WARP = f"""{SCENES},
cells AS (SELECT scene_id, CAST(r AS INTEGER) AS row, CAST(q AS INTEGER) AS col, 500003 + 4 * (scene_id % 7) + 10 * (q + 0.5::DOUBLE) AS x, 2000041 - 10 * (r + 0.5::DOUBLE) AS y FROM s, range(18) a(r), range(100) b(q)),
places AS (SELECT scene_id, row, col, (lon - {LON0}::DOUBLE) / {LON_STEP}::DOUBLE - 0.5::DOUBLE AS fc, ({LAT0}::DOUBLE - lat) / {LAT_STEP}::DOUBLE - 0.5::DOUBLE AS fr FROM {_lonlat_sql('x', 'y', 43, 'cells')}),
red AS (SELECT scene_id, row, col, nullif(dn_b_b04, 0) AS v FROM base),
near AS (SELECT t.*, r.v AS n FROM places t LEFT JOIN red r ON r.scene_id = t.scene_id AND r.row = CAST(floor(fr + 0.5) AS INTEGER) AND r.col = CAST(floor(fc + 0.5) AS INTEGER))"""


def _warped(spark, sf_dir, kernel):
    red = pixels.order_pixels(spark, sf_dir).select("scene_id", "row", "col", F.expr("nullif(dn_b_b04, 0)").alias("dn"))
    x = resample.resample(red, lonlat_grids(spark, sf_dir), utm_grids(spark, sf_dir), ["scene_id"], ["scene_id"], kernel)
    return x.select("scene_id", "row", "col", F.round("dn", 2).alias("dn"))


@query(with_(PIXELS, WARP) + "SELECT scene_id, row, col, CAST(n AS DOUBLE) AS dn FROM near")
def warped_nearest(spark, sf_dir):
    """A lon/lat raster on a UTM grid: the pixel in which each cell's centre lies."""
    return _warped(spark, sf_dir, "nearest")


@query(with_(PIXELS, WARP) + """SELECT t.scene_id, t.row, t.col, CASE WHEN any_value(t.n) IS NOT NULL THEN round(sum(r.v * (1 - abs(r.col - fc)) * (1 - abs(r.row - fr))) / sum((1 - abs(r.col - fc)) * (1 - abs(r.row - fr))), 2) END AS dn
FROM near t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc) LEFT JOIN red r ON r.v IS NOT NULL AND r.scene_id = t.scene_id AND r.row = CAST(floor(fr) AS INTEGER) + dr AND r.col = CAST(floor(fc) AS INTEGER) + dc
GROUP BY t.scene_id, t.row, t.col""")
def warped_bilinear(spark, sf_dir):
    """A lon/lat raster on a UTM grid: centres are brought into the raster's system and weighed there."""
    return _warped(spark, sf_dir, "bilinear")


# Footprints: quadrangles that lean by the key, so that some miss a corner of the area; the box of an area is 4 by 3.
FOOTPRINTS = """
prints AS (SELECT 'S' || k AS item_id, c % 40 AS aoi, CASE WHEN k % 2 = 0 THEN 'before' ELSE 'after' END AS role, (k * 37) % 101 AS cloud, 'T' || (k % 7) AS tile,
    c % 40 AS x0, c % 40 + 4 AS x1, c % 20 AS y0, c % 20 + 3 AS y1,
    c % 40 - 1 + (k % 5) / 2.0::DOUBLE AS x_a, c % 20 - 1.0::DOUBLE AS y_a, c % 40 + 6.0::DOUBLE AS x_b, c % 20 - (k % 3) / 2.0::DOUBLE AS y_b, c % 40 + 5 - (k % 4) / 2.0::DOUBLE AS x_c, c % 20 + 4.0::DOUBLE AS y_c, c % 40 - (k % 6) / 3.0::DOUBLE AS x_d, c % 20 + 3 + (k % 2) AS y_d FROM o),
edges AS (SELECT item_id, u.* FROM prints, LATERAL (VALUES (x_a, y_a, x_b, y_b), (x_b, y_b, x_c, y_c), (x_c, y_c, x_d, y_d), (x_d, y_d, x_a, y_a)) u(x1, y1, x2, y2)),
corners AS (SELECT item_id, v.* FROM prints, LATERAL (VALUES (1, x0, y0), (2, x0, y1), (3, x1, y0), (4, x1, y1)) v(n, x, y)),
holds AS (SELECT item_id, bool_and(inside) AS holds FROM (
    SELECT item_id, n, bool_or(on_edge) OR count(*) FILTER (met) % 2 = 1 AS inside FROM (
      SELECT p.item_id, n, (x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) AS on_edge,
             (y1 > y) <> (y2 > y) AND x < x1 + (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) AS met
      FROM corners p JOIN edges e ON p.item_id = e.item_id) GROUP BY item_id, n) GROUP BY item_id)"""


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "named_struct('x', cast({} as double), 'y', cast({} as double))".format
    ring = ", ".join((p("c % 40 - 1 + (k % 5) / 2.0D", "c % 20 - 1"), p("c % 40 + 6", "c % 20 - (k % 3) / 2.0D"), p("c % 40 + 5 - (k % 4) / 2.0D", "c % 20 + 4"), p("c % 40 - (k % 6) / 3.0D", "c % 20 + 3 + (k % 2)")))
    return derived.orders(spark, sf_dir).selectExpr(
        "concat('S', k) as item_id", "c % 40 as aoi", "if(k % 2 = 0, 'before', 'after') as role", "cast((k * 37) % 101 as double) as cloud_cover_percent", "concat('T', k % 7) as tile", f"array({ring}) as footprint",
        "named_struct('minx', cast(c % 40 as double), 'miny', cast(c % 20 as double), 'maxx', cast(c % 40 + 4 as double), 'maxy', cast(c % 20 + 3 as double)) as aoi_box",
    )


@query(with_(DERIVED, FOOTPRINTS) + "SELECT item_id, holds FROM holds")
def scene_containment(spark, sf_dir):
    """Scenes whose footprint holds all corners of the area."""
    b = [F.col(f"aoi_box.{k}") for k in ("minx", "miny", "maxx", "maxy")]
    return footprints(spark, sf_dir).select("item_id", catalog.contains_box("footprint", *b).alias("holds"))


@query(with_(DERIVED, FOOTPRINTS, "ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY aoi, role ORDER BY CASE WHEN tile = 'T3' THEN 0 ELSE 1 END, cloud, item_id) AS INTEGER) AS rank FROM prints)") + "SELECT aoi, role, item_id, rank FROM ranks JOIN holds USING (item_id) WHERE holds QUALIFY row_number() OVER (PARTITION BY aoi, role ORDER BY rank) = 1")
def scene_pick_containing(spark, sf_dir):
    """The first scene of each ranking that holds the whole area, and its place: better ones that miss a corner are passed over."""
    return catalog.pick_containing(footprints(spark, sf_dir), ["aoi", "role"], F.lit("T3")).select("aoi", "role", "item_id", "rank")
