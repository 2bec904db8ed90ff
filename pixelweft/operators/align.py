"""From readings on their own grids to pair pixels on one grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.functions import spectral as S
from pixelweft.operators import grid, resample
from pixelweft.schemas import BAND_ORDER, ROLES, STRICT
from pixelweft.sources.pixels import with_indexes
from pixelweft.storage import durable

RASTER = ["scene_id", "role", "band"]
CELL = ["scene_id", "row", "col"]
#: The name by which class codes go as a band.
CLASSES = "SCL"


def on_grid(pixels: DataFrame, meta: DataFrame, target: DataFrame, kernel: str = "bilinear") -> DataFrame:
    """Readings on the target grid of their scene. Rasters that are on it already are not resampled."""
    m, t = meta.alias("m"), target.alias("t")
    both = m.join(t.hint("merge"), F.col("m.scene_id") == F.col("t.scene_id")).select("m.scene_id", "m.role", "m.band", grid.same_grid("m", "t").alias("same"))
    both = durable(both, "rasters_on_grid")
    same, moved = both.where("same"), both.where("not same")
    if same.isEmpty():
        return resample.resample(pixels, meta, target, RASTER, ["scene_id"], kernel).select(*RASTER, "row", "col", "dn")
    as_is = pixels.join(same.select(*RASTER).hint("merge"), RASTER, "left_semi").select(*RASTER, "row", "col", F.col("dn").cast("double").alias("dn"))
    if moved.isEmpty():
        return as_is
    others = resample.resample(pixels, meta.join(moved.select(*RASTER).hint("merge"), RASTER, "left_semi"), target, RASTER, ["scene_id"], kernel)
    return as_is.unionByName(others.select(*RASTER, "row", "col", "dn"))


def prepare_pairs(pixels: DataFrame, meta: DataFrame, classes: DataFrame | None = None, class_meta: DataFrame | None = None, kernel: str = "bilinear", resolution: float | None = None, usable=STRICT) -> tuple[DataFrame, DataFrame]:
    """Pair pixels with reflectance, masks and NDVI, and the grids that they are on.

    ``pixels``: scene_id, role, band, row, col, dn; ``meta``: a grid and nodata for each raster. The dates may be in different reference systems.
    ``classes`` (scene_id, role, row, col, scl) and their grids are optional: without them all
    pixels are usable.
    """
    grids = durable(grid.common_grid(meta, ["scene_id"], resolution), "common_grids")
    cleaned = pixels.join(meta.select(*RASTER, "nodata").hint("merge"), RASTER).withColumn("dn", S.clean_dn("dn", F.col("nodata"))).drop("nodata")
    rows = on_grid(cleaned, meta, grids, kernel)
    if classes is not None:
        # beside the bands, so that one aggregation brings all layers of a cell together
        found = resample.resample_classes(classes, class_meta, grids, ["scene_id", "role"], ["scene_id"])
        rows = rows.unionByName(found.select("scene_id", "role", F.lit(CLASSES).alias("band"), "row", "col", F.col("scl").cast("double").alias("dn")))
    layer = lambda r, b: (F.col("role") == r) & (F.col("band") == b)
    x = S.reflectance("dn")
    cells = [F.max(F.when(layer(r, b), x)).alias(f"{r[0]}_{b.lower()}") for r in ROLES for b in BAND_ORDER]
    # a date's classes have a row for every cell, if they are there at all
    cells += [F.max(F.when(layer(r, CLASSES), F.col("dn"))).cast("int").alias(f"scl_{r}") for r in ROLES] + [(F.count_if(layer(r, CLASSES)) > 0).alias(f"scl_{r}_available") for r in ROLES]
    px = rows.groupBy(*CELL).agg(*cells, F.count_if(F.col("band") != CLASSES).alias("_bands")).where("_bands > 0").drop("_bands")
    for role in ROLES:
        # absent class data counts as usable: any usable code says so
        px = px.withColumn(f"scl_{role}", F.when(F.col(f"scl_{role}_available"), F.coalesce(f"scl_{role}", F.lit(0))).otherwise(F.lit(usable[0])))
    return with_indexes(px, usable), grids


def pair_metadata(px: DataFrame, grids: DataFrame) -> DataFrame:
    """A JSON document for each scene: grid, shares of valid pixels, NDVI statistics."""
    from pixelweft.operators import stats

    shares = px.groupBy("scene_id").agg(F.round(F.avg(F.col("valid_before").cast("int")), 6).alias("before_valid_fraction"), F.round(F.avg(F.col("valid_after").cast("int")), 6).alias("after_valid_fraction"), F.round(F.avg(F.col("valid").cast("int")), 6).alias("shared_valid_fraction"))
    ndvi = stats.describe(px, "ndvi_diff", ["scene_id"], "ndvi_diff_")
    g = grids.select("scene_id", F.struct("crs", "a", "b", "c", "d", "e", "f", "width", "height").alias("grid"))
    x = g.join(shares, "scene_id").join(ndvi, "scene_id")
    return x.select("scene_id", F.to_json(F.struct(*(c for c in x.columns if c != "scene_id"))).alias("document"))
