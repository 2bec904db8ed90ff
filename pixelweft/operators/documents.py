"""Documents of a pair, an inference, an acquisition and an evaluation: layers are written, their files listed and hashed, and one nested row put together for each scene.

A document is a row of structs, so that ``sinks.document`` writes it as one JSON object, and any query can read its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.operators import evaluation, masking, stats, validate
from pixelweft.schemas import BAND_ORDER, CLASS_NAMES, ROLES, STRICT
from pixelweft.sources import sinks

OBSERVATION = "struct<item_id string, acquisition_date date, mgrs_tile string, cloud_cover_percent double>"


def nested(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, a struct of all other columns)."""
    return rows.select(key, F.struct(*(c for c in rows.columns if c != key)).alias(name))


def listed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, an array of structs of all other columns, in order). One entry for each of few rows: bands, roles, checks, files."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*(c for c in rows.columns if c not in keys)))).alias(name))


def joined(first: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    for x in others:
        first = first.join(x.hint("merge"), key, "left")
    return first


def output_files(spark: SparkSession, folders: dict[str, str], key: str = "scene_id") -> DataFrame:
    """Rows (key, outputs: an array of output, file, bytes, sha256) of layers that were written by scene (``folder/scene_id=.../part-*``). File contents are hashed one at a time by the task that reads them."""
    out = None
    for name, folder in folders.items():
        x = sinks.file_records(spark, folder).select(F.regexp_extract("path", f"/{key}=([^/]+)/", 1).alias(key), F.lit(name).alias("output"), F.substring_index("path", "/", -1).alias("file"), "bytes", "sha256")
        x = x.where(F.col("file").endswith(".parquet"))
        out = x if out is None else out.unionByName(x)
    return listed(out, [key], "outputs")


def observation_summary(readings: DataFrame, meta: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """One row for each scene and role: provenance, size and system of its first band, statistics of the reflectance of each band, and the class band's share of no data.

    ``readings`` (scene_id, role, band, row, col, x), NULL for invalid; ``meta``: a grid for each raster; ``provenance`` (scene_id, role, and the fields of an acquisition).
    A scene without a class band has all its pixels as no data there, and ``class_band`` false; one without provenance has NULLs.
    """
    keys = ["scene_id", "role"]
    bands = readings.where(F.col("band").isin(list(BAND_ORDER)))
    per_band = listed(stats.describe(bands, "x", [*keys, "band"]), keys, "bands")
    scl = readings.where("band = 'SCL'").groupBy(*keys).agg(F.count_if(F.coalesce(F.col("x"), F.lit(0.0)) == 0).alias("no_data"), F.count("*").alias("n"))
    first = meta.where(F.col("band").isin(list(BAND_ORDER))).groupBy(*keys).agg(F.min_by(F.struct("crs", "width", "height", F.abs("a").alias("resolution")), "band").alias("grid"))
    x = first.join(per_band.hint("merge"), keys, "left").join(scl.hint("merge"), keys, "left")
    wanted = [n.split()[0] for n in OBSERVATION[7:-1].split(", ")]
    given = provenance.select(*keys, F.struct(*wanted).cast(OBSERVATION).alias("provenance")) if provenance is not None else None
    x = x.join(given.hint("merge"), keys, "left") if given is not None else x.withColumn("provenance", F.lit(None).cast(OBSERVATION))
    size = F.col("grid.width").cast("long") * F.col("grid.height")
    return x.select(*keys, "provenance", "grid", "bands", F.col("n").isNotNull().alias("class_band"), F.coalesce(F.col("no_data") / F.col("n"), F.when(size > 0, 1.0)).alias("class_no_data_fraction"))


def pair_documents(px: DataFrame, grids: DataFrame, observations: DataFrame, folder: str, usable=STRICT) -> DataFrame:
    """Write the layers of prepared pairs below ``folder`` and give their documents: scene_id, grid, bands, normalization, nodata_policy, cloud_mask, observations, ndvi, validation, outputs.

    ``px``: rows of ``align.prepare_pairs``; ``observations``: of ``observation_summary``, or (scene_id, role, ...) of any kind.
    """
    spark = px.sparkSession
    layers = {"before": lambda p: sinks.reflectance_stack(px, p, "b"), "after": lambda p: sinks.reflectance_stack(px, p, "a"), "ndvi_difference": lambda p: sinks.ndvi_layer(px, p)}
    layers |= {f"scl_{r}": (lambda r: lambda p: sinks.class_layer(px, p, f"scl_{r}"))(r) for r in ROLES}
    folders = {name: f"{folder}/{name}" for name in layers}
    for name, write in layers.items():
        write(folders[name])
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    shares = px.groupBy("scene_id").agg(share("valid").alias("shared"), F.count_if(~F.col("valid")).alias("masked"), share("valid_before").alias("before"), share("valid_after").alias("after"))
    sides = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"scl_{r}").alias("scl")) for r in ROLES))).alias("p")
    reports = masking.mask_report(px.select("scene_id", sides).select("scene_id", "p.*"), ["scene_id", "role"])
    ndvi = stats.describe(px, "ndvi_diff", ["scene_id"])
    areas = stats.change_areas(px, ["scene_id"])
    fixed = lambda values: F.lit(list(values))
    x = joined(
        grids.select("scene_id", F.struct("crs", "a", "b", "c", "d", "e", "f", "width", "height").alias("grid")), "scene_id", nested(shares, "scene_id", "_s"), listed(reports, ["scene_id"], "_reports"),
        listed(observations, ["scene_id"], "observations"), nested(ndvi, "scene_id", "_ndvi"), nested(areas, "scene_id", "_areas"), listed(validate.processed_checks(px), ["scene_id"], "validation"),
        output_files(spark, folders).withColumn("scene_id", F.col("scene_id").cast(px.schema["scene_id"].dataType)),
    )
    s = lambda n: F.col(f"_s.{n}")
    return x.select(
        "scene_id", "grid", fixed(BAND_ORDER).alias("bands"), F.struct(F.lit(10000.0).alias("scale"), fixed((0.0, 1.0)).alias("clip")).alias("normalization"),
        F.struct(F.lit(0).alias("disk_nodata_value"), s("shared").alias("shared_valid_fraction"), s("before").alias("before_valid_fraction"), s("after").alias("after_valid_fraction")).alias("nodata_policy"),
        F.struct(fixed(usable).alias("valid_classes"), fixed(sorted(set(CLASS_NAMES) - set(usable))).alias("masked_classes"), s("masked").alias("masked_pixels"), F.col("_reports").alias("reports")).alias("cloud_mask"),
        "observations", F.struct(F.col("_ndvi").alias("difference"), F.col("_areas").alias("change_areas")).alias("ndvi"), "validation", "outputs",
    )


def inference_documents(scored: DataFrame, grids: DataFrame, folder: str, threshold: float, model: str) -> DataFrame:
    """Write probability and mask of scored pixels below ``folder`` and give their documents: scene_id, model, threshold, crs, shape, statistics, outputs."""
    sinks.change_layers(scored, f"{folder}/change")
    files = output_files(scored.sparkSession, {"change": f"{folder}/change"}).withColumn("scene_id", F.col("scene_id").cast(scored.schema["scene_id"].dataType))
    where = grids.select("scene_id", "crs", F.array("height", "width").alias("shape"))
    x = joined(where, "scene_id", nested(stats.inference_stats(scored, ["scene_id"]), "scene_id", "statistics"), files)
    return x.select("scene_id", F.lit(model).alias("model"), F.lit(threshold).alias("threshold"), "crs", "shape", "statistics", "outputs")


def acquisition_documents(chosen: DataFrame, band_stats: DataFrame, windows: DataFrame, key: str = "aoi") -> DataFrame:
    """One document for each area: both observations with their scene, window and the statistics of each band.

    ``chosen`` (key, role, item_id, ts, cloud_cover_percent, tile), ``band_stats`` (key, role, band, ...), ``windows`` (key, role, row0, row1, col0, col1). An observation that lacks one of these has NULL there.
    """
    w = windows.select(key, "role", F.struct(F.col("col0").alias("col_off"), F.col("row0").alias("row_off"), (F.col("col1") - F.col("col0")).alias("width"), (F.col("row1") - F.col("row0")).alias("height")).alias("window"))
    x = chosen.join(w.hint("merge"), [key, "role"], "left").join(listed(band_stats, [key, "role"], "bands").hint("merge"), [key, "role"], "left")
    x = x.select(key, "role", "item_id", F.to_date("ts").alias("acquisition_date"), F.round("cloud_cover_percent", 4).alias("cloud_cover_percent"), F.col("tile").alias("mgrs_grid"), "window", "bands")
    roles = {r: F.max(F.when(F.col("role") == r, F.struct(*(c for c in x.columns if c not in (key, "role"))))).alias(r) for r in ROLES}
    return x.groupBy(key).agg(*roles.values())


def evaluation_document(per_sample: DataFrame, dataset: str, split: str, threshold: float, model: str) -> DataFrame:
    """One document of an evaluation: dataset, model, threshold, metrics over all cells, and a summary of the samples."""
    spread: list[Column] = [f(c).alias(f"{n}_{c}") for c in ("iou", "f1") for n, f in (("min", F.min), ("mean", lambda v: F.round(F.avg(v), 6)), ("max", F.max))]
    whole = evaluation.overall(per_sample)
    counts = per_sample.agg(*spread, F.count_if(F.col("iou") == 0).alias("without_hit"))
    both = whole.select(F.lit(1).alias("_k"), F.struct(*whole.columns).alias("metrics")).join(counts.select(F.lit(1).alias("_k"), F.struct(*counts.columns).alias("samples")).hint("merge"), "_k")
    return both.select(F.struct(F.lit(dataset).alias("name"), F.lit(split).alias("split"), F.col("metrics.samples").alias("sample_count")).alias("dataset"), F.lit(model).alias("model"), F.lit(threshold).alias("threshold"), "metrics", "samples")
