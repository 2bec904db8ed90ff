"""Grids: geometry as columns (crs, a..f, width, height), and lon/lat to UTM and back in closed form.

The affine is x = a * col + b * row + c, y = d * col + e * row + f, with e < 0 for north-up grids.
"""

from __future__ import annotations

import math
from types import ModuleType

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.functions.spectral import col

# WGS84 and the Krüger series of the transverse Mercator projection (Karney 2011, to n^4).
SEMI_MAJOR, FLATTENING, K0, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def properties(grids: DataFrame) -> DataFrame:
    """Adds xres, yres, minx, miny, maxx, maxy, pixel_area_m2 and area_km2."""
    g = grids.withColumns({"xres": F.abs("a"), "yres": F.abs("e"), "minx": F.col("c"), "maxy": F.col("f"), "pixel_area_m2": F.abs(F.col("a") * F.col("e"))})
    g = g.withColumns({"maxx": F.col("c") + F.col("a") * F.col("width"), "miny": F.col("f") + F.col("e") * F.col("height")})
    return g.withColumn("area_km2", F.round(F.col("pixel_area_m2") * F.col("width") * F.col("height") / 1e6, 6))


def utm_zone(crs: Column | str) -> Column:
    """The zone of EPSG:326zz or 327zz; NULL for any other reference system."""
    return F.when(col(crs).rlike("^EPSG:32[67][0-9]{2}$"), F.substring(col(crs), -2, 2).cast("int"))


def is_south(crs: Column | str) -> Column:
    return F.substring(col(crs), 1, 8) == "EPSG:327"


def _series(m: ModuleType, phi, lam):
    """Easting and northing over ``K0 * RADIUS`` of a latitude and a longitude from the central meridian, in radians. ``m``: pyspark's functions for columns, numpy for arrays."""
    k = 2 * math.sqrt(N) / (1 + N)
    t = m.sinh(m.atanh(m.sin(phi)) - k * m.atanh(k * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(1 + t * t))
    e = eta + sum(a * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    n = xi + sum(a * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
    return e, n


def _inverse_series(m: ModuleType, eta, xi):
    """Latitude and longitude from the central meridian, in radians, of an easting and a northing over ``K0 * RADIUS``."""
    xi1 = xi - sum(b * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    eta1 = eta - sum(b * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    chi = m.asin(m.sin(xi1) / m.cosh(eta1))
    return chi + sum(d * m.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)), m.atan2(m.sinh(eta1), m.cos(xi1))


def utm_from_lonlat(lon: Column | str, lat: Column | str, zone: Column, south: Column | bool = False) -> tuple[Column, Column]:
    e, n = _series(F, F.radians(col(lat)), F.radians(col(lon) - (zone * 6 - 183)))
    south = F.lit(south) if isinstance(south, bool) else south
    return FALSE_EASTING + K0 * RADIUS * e, K0 * RADIUS * n + F.when(south, 1e7).otherwise(0.0)


def lonlat_from_utm(x: Column | str, y: Column | str, zone: Column, south: Column | bool = False) -> tuple[Column, Column]:
    south = F.lit(south) if isinstance(south, bool) else south
    xi = (col(y) - F.when(south, 1e7).otherwise(0.0)) / (K0 * RADIUS)
    eta = (col(x) - FALSE_EASTING) / (K0 * RADIUS)
    phi, lam = _inverse_series(F, eta, xi)
    return F.degrees(lam) + (zone * 6 - 183), F.degrees(phi)


def system(crs: str, prefix: str = "") -> dict[str, Column]:
    """What ``projected_arrays`` has to know of the system in column ``crs``: whether it is lon/lat, its UTM zone (NULL for any other) and its false northing."""
    return {f"{prefix}lonlat": F.coalesce(is_lonlat(crs), F.lit(False)), f"{prefix}zone": utm_zone(crs).cast("double"), f"{prefix}north": F.when(is_south(crs), 1e7).otherwise(0.0)}


def projected_arrays(x: np.ndarray, y: np.ndarray, source: tuple[np.ndarray, ...], target: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """``projected`` for arrays: (x, y) of the systems ``source``, each (lonlat, zone, north) of ``system``, in those of ``target``; NaN where a system is neither lon/lat nor UTM."""
    with np.errstate(all="ignore"):
        lon, lat = x.copy(), y.copy()
        (lonlat, zone, north), scale = source, K0 * RADIUS
        if not lonlat.all():
            i = np.flatnonzero(~lonlat)
            phi, lam = _inverse_series(np, (x[i] - FALSE_EASTING) / scale, (y[i] - north[i]) / scale)
            lon[i], lat[i] = np.degrees(lam) + (zone[i] * 6 - 183), np.where(np.isnan(zone[i]), np.nan, np.degrees(phi))
        lonlat, zone, north = target
        if not lonlat.all():
            i = np.flatnonzero(~lonlat)
            e, n = _series(np, np.radians(lat[i]), np.radians(lon[i] - (zone[i] * 6 - 183)))
            lon[i], lat[i] = FALSE_EASTING + scale * e, scale * n + north[i]
    return lon, lat


def is_lonlat(crs: Column | str) -> Column:
    return col(crs) == "EPSG:4326"


def projected(points: DataFrame, x: str, y: str, source: str, target: str, to: tuple[str, str] = ("px", "py")) -> DataFrame:
    """``points`` with the columns ``to``: (x, y) of the reference system in column ``source``, in that of ``target``.

    Systems are lon/lat (EPSG:4326) and the UTM zones; any other gives NULL, unless both are the same, when (x, y) stay as they are.
    By way of lon/lat, each step a projection of its own, so that no series is written out within another.
    """
    same = F.col(source).eqNullSafe(F.col(target))
    lon, lat = lonlat_from_utm(x, y, utm_zone(source), is_south(source))
    step = points.withColumns({"_lon": F.when(~same, F.when(is_lonlat(source), F.col(x)).otherwise(lon)), "_lat": F.when(~same, F.when(is_lonlat(source), F.col(y)).otherwise(lat))})
    e, n = utm_from_lonlat("_lon", "_lat", utm_zone(target), is_south(target))
    out = {to[0]: F.when(same, F.col(x)).when(is_lonlat(target), F.col("_lon")).otherwise(e), to[1]: F.when(same, F.col(y)).when(is_lonlat(target), F.col("_lat")).otherwise(n)}
    return step.withColumns(out).drop("_lon", "_lat")


def bounds_in(boxes: DataFrame, source: str, target: str, keys: list[str], steps: int = 21) -> DataFrame:
    """Boxes (keys, minx, miny, maxx, maxy) of the system ``source`` to the bounds of their edges in that of ``target``, ``steps`` stretches an edge."""
    share = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)).alias("s")
    s, w, h = F.col("s"), F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    edge = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    sides = F.array(edge(F.col("minx") + w * s, F.col("miny")), edge(F.col("minx") + w * s, F.col("maxy")), edge(F.col("minx"), F.col("miny") + h * s), edge(F.col("maxx"), F.col("miny") + h * s))
    named = list(dict.fromkeys([*keys, source, target]))
    points = boxes.select("*", share).select(*named, F.explode(sides).alias("p")).select(*named, "p.*")
    return projected(points, "x", "y", source, target).groupBy(*keys).agg(F.min("px").alias("minx"), F.min("py").alias("miny"), F.max("px").alias("maxx"), F.max("py").alias("maxy"))


def utm_bounds(boxes: DataFrame, target: str = "crs", keys: list[str] | None = None, steps: int = 21) -> DataFrame:
    """Boxes in lon/lat (keys, minx, miny, maxx, maxy, ``target``) to the bounds of their edges in the UTM zone of ``target``."""
    keys = keys or [c for c in boxes.columns if c not in ("minx", "miny", "maxx", "maxy")]
    return bounds_in(boxes.withColumn("_from", F.lit("EPSG:4326")), "_from", target, keys, steps)


def intersection(a: str, b: str) -> dict[str, Column]:
    """minx..maxy of the overlap of the boxes with prefixes a and b; NULL where they are apart or only touch."""
    lo = lambda k: F.greatest(f"{a}{k}", f"{b}{k}")
    hi = lambda k: F.least(f"{a}{k}", f"{b}{k}")
    ok = (lo("minx") < hi("maxx")) & (lo("miny") < hi("maxy"))
    return {k: F.when(ok, lo(k) if k.startswith("min") else hi(k)) for k in ("minx", "miny", "maxx", "maxy")}


def snapped(boxes: DataFrame, res: str = "res") -> DataFrame:
    """Boxes (crs, minx.., res) snapped outward to the resolution, as grids; rows that have no area or no positive resolution go."""
    r = F.col(res)
    g = boxes.where((r > 0) & (F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")))
    down, up = (lambda c: F.floor(F.round(F.col(c) / r, 6)) * r), (lambda c: F.ceil(F.round(F.col(c) / r, 6)) * r)
    g = g.withColumns({"_x0": down("minx"), "_y0": down("miny"), "_x1": up("maxx"), "_y1": up("maxy")})
    return g.withColumns({
        "a": r.cast("double"), "b": F.lit(0.0), "c": F.col("_x0").cast("double"), "d": F.lit(0.0), "e": -r.cast("double"), "f": F.col("_y1").cast("double"),
        "width": F.round((F.col("_x1") - F.col("_x0")) / r).cast("int"), "height": F.round((F.col("_y1") - F.col("_y0")) / r).cast("int"),
    }).drop("_x0", "_y0", "_x1", "_y1", "minx", "miny", "maxx", "maxy")


def common_grid(meta: DataFrame, by: list[str], resolution: float | None = None, crs: str | None = None) -> DataFrame:
    """One grid for each group of rasters: the intersection of their bounds, at the finest resolution of those in its system unless one is given.

    The grid is in the system ``crs``, else in that of the group's first raster: the before date first, then by band, then by name of the system.
    Rasters in another system have their bounds brought over, by the points of their edges. Groups that don't overlap, or have a
    raster in a system that is neither lon/lat nor UTM beside others, give no row.
    """
    order = [F.when(F.col("role") == "before", 0).otherwise(1)] if "role" in meta.columns else []
    first = F.min_by("crs", F.struct(*order, *([F.col("band")] if "band" in meta.columns else []), F.col("crs")))
    # one row for each geometry: the bands of a date mostly share theirs
    shapes = properties(meta).groupBy(*by, "crs", "minx", "miny", "maxx", "maxy").agg(F.min(F.least("xres", "yres")).alias("res"))
    chosen = meta.select(*by).distinct().withColumn("to", F.lit(crs)) if crs else meta.groupBy(*by).agg(first.alias("to"))
    shapes = shapes.join(chosen.hint("merge"), by)
    moved = bounds_in(shapes.where("crs != to"), "crs", "to", [*by, "crs", "to", "res"]).withColumn("res", F.lit(None).cast("double"))
    sides = ("minx", "miny", "maxx", "maxy")
    x = shapes.where("crs = to").select(*by, "to", "res", *sides).unionByName(moved.select(*by, "to", "res", *sides))
    g = x.groupBy(*by).agg(
        F.max("minx").alias("minx"), F.max("miny").alias("miny"), F.min("maxx").alias("maxx"), F.min("maxy").alias("maxy"),
        (F.lit(float(resolution)) if resolution else F.min("res")).alias("res"), F.min("to").alias("crs"), F.count_if(F.col("minx").isNull()).alias("_lost"),
    )
    return snapped(g.where("_lost = 0").drop("_lost")).drop("res")


def same_grid(a: str, b: str) -> Column:
    ok = F.lit(True)
    for k in ("a", "b", "c", "d", "e", "f", "width", "height", "crs"):
        ok = ok & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return ok


def pixel_window(scene: DataFrame) -> DataFrame:
    """Rows with a grid and a box (minx..maxy) get row0, row1, col0, col1 (half open) and inside."""
    s = scene.withColumns({
        "col0": F.floor(F.round((F.col("minx") - F.col("c")) / F.col("a"), 6)).cast("int"), "col1": F.ceil(F.round((F.col("maxx") - F.col("c")) / F.col("a"), 6)).cast("int"),
        "row0": F.floor(F.round((F.col("maxy") - F.col("f")) / F.col("e"), 6)).cast("int"), "row1": F.ceil(F.round((F.col("miny") - F.col("f")) / F.col("e"), 6)).cast("int"),
    })
    return s.withColumn("inside", (F.col("col0") >= 0) & (F.col("row0") >= 0) & (F.col("col1") <= F.col("width")) & (F.col("row1") <= F.col("height")))


def aoi_bounds(aoi: DataFrame) -> DataFrame:
    """Areas (lon, lat, edge_m, res, crs) to UTM bounds snapped down to the grid: minx, miny, maxx, maxy."""
    x, y = utm_from_lonlat("lon", "lat", utm_zone("crs"), is_south("crs"))
    down = lambda v: F.floor((v - F.col("edge_m") / 2) / F.col("res")) * F.col("res")
    a = aoi.withColumns({"minx": down(x), "miny": down(y)})
    return a.withColumns({"maxx": F.col("minx") + F.col("edge_m"), "maxy": F.col("miny") + F.col("edge_m")})


def aoi_lonlat(aoi: DataFrame) -> DataFrame:
    """UTM bounds with the lon/lat box of their corners: min_lon, min_lat, max_lon, max_lat."""
    corners = [lonlat_from_utm(x, y, utm_zone("crs"), is_south("crs")) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    lon, lat = [c[0] for c in corners], [c[1] for c in corners]
    return aoi.withColumns({"min_lon": F.least(*lon), "min_lat": F.least(*lat), "max_lon": F.greatest(*lon), "max_lat": F.greatest(*lat)})
