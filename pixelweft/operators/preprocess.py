"""Raw readings of two dates to prepared pairs with their documents: checks, common grid, masks, layers and files in one chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.operators import align, documents, grid, validate
from pixelweft.schemas import BAND_ORDER, ROLES, STRICT
from pixelweft.storage import durable

KEY = "scene_id"


def _boxes(meta: DataFrame) -> DataFrame:
    """scene_id, before_crs, after_crs and the boxes b_minx.., a_minx.. of both dates' first bands, all in the system of the date before."""
    first = meta.where(F.col("band").isin(list(BAND_ORDER))).groupBy(KEY, "role").agg(F.min_by(F.struct("crs", "a", "c", "e", "f", "width", "height"), "band").alias("g"))
    sides = first.groupBy(KEY).agg(*(F.max(F.when(F.col("role") == r, F.col("g"))).alias(r) for r in ROLES))
    box = lambda r: {"minx": F.col(f"{r}.c"), "miny": F.col(f"{r}.f") + F.col(f"{r}.e") * F.col(f"{r}.height"), "maxx": F.col(f"{r}.c") + F.col(f"{r}.a") * F.col(f"{r}.width"), "maxy": F.col(f"{r}.f")}
    crs = [F.col(f"{r}.crs").alias(f"{r}_crs") for r in ROLES]
    before = sides.select(KEY, *crs, *(x.alias(f"b_{n}") for n, x in box("before").items()))
    after = grid.bounds_in(sides.select(KEY, *crs, *(x.alias(n) for n, x in box("after").items())), "after_crs", "before_crs", [KEY])
    return before.join(after.select(KEY, *(F.col(n).alias(f"a_{n}") for n in ("minx", "miny", "maxx", "maxy"))).hint("merge"), KEY, "left")


def raw_checks(pixels: DataFrame, meta: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Rows (scene_id, part, check, passed) for the raw rasters of each scene in ``meta``.

    Parts are 'before' and 'after' (bands, geometry, and class data where the date has any), 'crs' and 'bounds'. A date without readings
    fails ``bands_present``, one without a grid ``crs_valid``. That both systems are the same isn't asked for.
    """
    keys = [KEY, "role"]
    own = [validate.band_checks(pixels, keys), validate.meta_checks(meta, keys)]
    wanted = meta.select(KEY).distinct().select(KEY, F.explode(F.lit(list(ROLES))).alias("role"))
    for rows, name in ((pixels, "bands_present"), (meta, "crs_valid")):
        absent = wanted.join(rows.select(*keys).distinct().hint("merge"), keys, "left_anti")
        own.append(absent.select(*keys, F.lit(name).alias("check"), F.lit(False).alias("passed")))
    if classes is not None:
        own.append(validate.class_checks(classes, keys))
    out = own[0]
    for x in own[1:]:
        out = out.unionByName(x)
    out = out.join(meta.select(KEY).distinct().hint("merge"), KEY, "left_semi").withColumnRenamed("role", "part")
    pairs = durable(_boxes(meta), "pair_boxes")
    shared = validate.bounds_overlap(pairs)
    shared = validate.stacked(shared, [KEY], {n: F.col(n) for n in ("bounds_overlap", "overlap_covers_smaller_footprint")}).withColumn("part", F.lit("bounds"))
    systems = validate.crs_checks(pairs).where("check != 'crs_identical'").withColumn("part", F.lit("crs"))
    return out.unionByName(systems).unionByName(shared).select(KEY, "part", "check", "passed")


def verdicts(checks: DataFrame) -> DataFrame:
    """(scene_id, passed, problems): the failed checks of each scene as sorted texts 'part: check'."""
    failed: Column = F.when(~F.col("passed"), F.concat_ws(": ", "part", "check"))
    return checks.groupBy(KEY).agg(F.bool_and("passed").alias("passed"), F.sort_array(F.collect_list(failed)).alias("problems"))


def preprocess(
    pixels: DataFrame, meta: DataFrame, folder: str, classes: DataFrame | None = None, class_meta: DataFrame | None = None, provenance: DataFrame | None = None, kernel: str = "bilinear",
    resolution: float | None = None, usable=STRICT, refuse: bool = True,
) -> DataFrame:
    """One row for each scene in ``meta``: scene_id, passed, problems, and the document of its pair, whose layers are written below ``folder``.

    ``pixels`` (scene_id, role, band, row, col, dn) and ``meta`` (a grid and nodata for each raster) are as ``align.prepare_pairs`` takes them, ``classes`` and ``class_meta`` too; ``provenance`` as
    ``documents.observation_summary``. A scene that fails a check of ``raw_checks`` has no document (NULL) and writes nothing, unless ``refuse`` is false; others are not held up by it. A
    scene whose dates share no ground never has one. No scene, an empty result.
    """
    found = durable(verdicts(raw_checks(pixels, meta, classes)), "raw_verdicts")
    chosen = found.where("passed").select(KEY) if refuse else found.select(KEY)
    of = lambda x: x.join(chosen.hint("merge"), KEY, "left_semi") if x is not None else None
    pixels, meta, classes, class_meta = (of(x) for x in (pixels, meta, classes, class_meta))
    px, grids = align.prepare_pairs(pixels, meta, classes, class_meta, kernel, resolution, usable)
    px, grids = durable(px, "prepared_pairs"), durable(grids, "pair_grids")
    raw = pixels.join(meta.select(*align.RASTER, "nodata").hint("merge"), align.RASTER).select(*align.RASTER, "row", "col", F.when(~F.col("dn").eqNullSafe(F.col("nodata")), F.col("dn") / 10000.0).alias("x"))
    if classes is not None:
        raw = raw.unionByName(classes.select(KEY, "role", F.lit("SCL").alias("band"), "row", "col", F.col("scl").cast("double").alias("x")))
    seen = documents.observation_summary(raw, meta, provenance)
    written = documents.pair_documents(px, grids, seen, folder, usable)
    document = written.select(KEY, F.struct(*(c for c in written.columns if c != KEY)).alias("document"))
    return found.join(durable(document, "pair_documents").hint("merge"), KEY, "left")
