"""Labelled regions from an index of files: two dates of bands and a change mask for each region, on the grid of the first band.

Files are rows (region, folder, filename), their pixels rows (region, folder, filename, row, col, value), their grids a row each. Names are compared
without regard to case, as archives differ in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.functions import spectral as S
from pixelweft.operators import datasets, resample
from pixelweft.schemas import BAND_ORDER, ROLES
from pixelweft.storage import durable

# The folders of the two dates, the first pair that a region has counts; and where its mask may lie, in order.
DATE_FOLDERS = (("imgs_1_rect", "imgs_2_rect"), ("imgs_1", "imgs_2"))
MASK_FILES = ("target/cm/cm.png", "cm/cm.png", "target/cm.png")

FILE = ["region", "folder", "filename"]


def checked_splits(splits: DataFrame, needed: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """``splits`` (split, region), once it is sure that each of ``needed`` has regions and no region is in two; else ValueError.

    Region names that differ in case are one region. The check is a job over the names.
    """
    x = splits.select("split", F.trim("region").alias("region")).where("region != ''")
    per = x.groupBy(F.lower("region").alias("r")).agg(F.count_distinct("split").alias("n"))
    facts = per.agg(F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("r")))).alias("twice")).first()  # names only
    have = {r["split"] for r in x.select("split").distinct().collect()}
    empty = [s for s in needed if s not in have]
    if empty:
        raise ValueError(f"splits without regions: {', '.join(empty)}")
    if facts["twice"]:
        raise ValueError(f"regions in more than one split: {', '.join(facts['twice'])}")
    return x


def _first(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The file of each key that comes first."""
    return rows.withColumn("_o", order).where("_o is not null").groupBy(*keys).agg(F.min(F.struct("_o", "folder", "filename")).alias("f")).select(*keys, "f.folder", "f.filename")


def band_files(files: DataFrame, bands: tuple[str, ...] = BAND_ORDER) -> DataFrame:
    """Rows (region, role, band, folder, filename): the file of each band of each date, from the first pair of folders of which the region has both."""
    name, folder = F.lower("filename"), F.lower("folder")
    place = lambda n: F.coalesce(*(F.when(folder == pair[n], i) for i, pair in enumerate(DATE_FOLDERS)))
    have = files.groupBy("region").agg(F.collect_set(folder).alias("have"))
    pair = F.coalesce(*(F.when(F.array_contains("have", a) & F.array_contains("have", b), i) for i, (a, b) in enumerate(DATE_FOLDERS)))
    chosen = have.select("region", pair.alias("pair")).where("pair is not null")
    band = F.coalesce(*(F.when(name == f"{b.lower()}.tif", b) for b in bands))
    x = files.join(chosen.hint("merge"), "region").withColumn("band", band).where("band is not null")
    x = x.withColumn("role", F.when(place(0) == F.col("pair"), ROLES[0]).when(place(1) == F.col("pair"), ROLES[1])).where("role is not null")
    return _first(x, ["region", "role", "band"], F.when(F.col("filename") == F.concat(F.col("band"), F.lit(".tif")), 0).otherwise(1))


def mask_files(files: DataFrame) -> DataFrame:
    """Rows (region, folder, filename): the first place at which a region has its mask; regions without one have no row."""
    path = F.lower(F.concat_ws("/", "folder", "filename"))
    return _first(files, ["region"], F.coalesce(*(F.when(path == p, i) for i, p in enumerate(MASK_FILES))))


def missing(files: DataFrame, regions: DataFrame, bands: tuple[str, ...] = BAND_ORDER) -> DataFrame:
    """Rows (region, role, band) that a region ought to have and has no file for."""
    wanted = regions.select("region").distinct().select("region", F.explode(F.lit(list(ROLES))).alias("role")).select("region", "role", F.explode(F.lit(list(bands))).alias("band"))
    return wanted.join(band_files(files, bands).hint("merge"), ["region", "role", "band"], "left_anti")


def load(files: DataFrame, pixels: DataFrame, grids: DataFrame, splits: DataFrame | None = None, split: str | None = None, bands: tuple[str, ...] = BAND_ORDER) -> DataFrame:
    """Rows (region, row, col, before_b02.., after_b02.., target, annotated) on the grid of each region's first band of the before date, reflectance from 0 to 1.

    Bands of another resolution are brought onto that grid (bilinear; grids (region, folder, filename, a, c, e, f, width, height)). A region without a mask has target 0 everywhere and ``annotated`` false. With ``splits`` and ``split``
    only that split's regions are loaded, after ``checked_splits``. A region that lacks a band or a date, or a split's region that isn't there, is an error: ValueError names the first ones.
    """
    if splits is not None:
        wanted = checked_splits(splits).where(F.col("split") == split).select(F.lower("region").alias("_r")).distinct()
        regions = files.select("region").distinct().withColumn("_r", F.lower("region"))
        absent = [r["_r"] for r in wanted.join(regions.hint("merge"), "_r", "left_anti").orderBy("_r").limit(20).collect()]
        if absent:
            raise ValueError(f"regions of split {split} that are not there: {', '.join(absent)}")
        files = files.join(regions.join(wanted.hint("merge"), "_r", "left_semi").select("region").hint("merge"), "region", "left_semi")
    lost = [f"{r['region']}/{r['role']}/{r['band']}" for r in missing(files, files, bands).orderBy("region", "role", "band").limit(20).collect()]
    if lost:
        raise ValueError(f"no file for: {', '.join(lost)}")
    chosen = band_files(files, bands)
    keys = ["region", "role", "band"]
    own = grids.join(chosen.hint("merge"), FILE).select(*FILE, *keys[1:], *resample.GRID)
    target = own.where((F.col("role") == ROLES[0]) & (F.col("band") == bands[0])).select("region", *resample.GRID)
    same = F.lit(True)
    for c in resample.GRID:
        same = same & (F.col(f"o.{c}") == F.col(f"t.{c}"))
    placed = own.alias("o").join(target.alias("t").hint("merge"), F.col("o.region") == F.col("t.region"), "left").groupBy(*(F.col(f"o.{c}").alias(c) for c in dict.fromkeys([*FILE, *keys]))).agg(F.max(F.coalesce(same, F.lit(False))).alias("same"))
    # what a file is for comes to its pixels in one join; they are a table, as bands and masks go different ways
    uses = placed.select(*FILE, "role", "band", "same").unionByName(mask_files(files).select(*FILE, *(F.lit(None).cast(t).alias(n) for n, t in (("role", "string"), ("band", "string"), ("same", "boolean")))))
    rows = durable(pixels.join(durable(uses, "used_files").hint("merge"), FILE).select(*keys, "same", "row", "col", "value"), "region_pixels")
    values = [*keys, "row", "col", F.col("value").cast("double").alias("dn")]
    moved = own.join(placed.where("not same").select(*keys).hint("merge"), keys, "left_semi").select(*keys, *resample.GRID)
    brought = resample.resample(rows.where("not same").select(*values), moved, target, keys, ["region"])
    x = rows.where("same").select(*values).unionByName(brought)
    cells = [F.max(F.when((F.col("role") == r) & (F.col("band") == b), S.reflectance("dn"))).alias(f"{r}_{b.lower()}") for r in ROLES for b in bands]
    wide = x.groupBy("region", "row", "col").agg(*cells)
    masks = rows.where("same is null").select("region", "row", "col", "value")
    return datasets.with_target(wide, masks, ["region", "row", "col"])
