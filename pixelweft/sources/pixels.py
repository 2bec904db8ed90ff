"""Pixel tables.

``pixels_long`` has a row for each reading (scene_id, role, band, row, col, dn); ``pixels_wide`` a
row for each cell of a pair, with reflectance in eight nullable columns and the two scene classes.
The driver's star schema holds no imagery, so an order stands for a pixel: 1500 orders in key
order make a scene of 15 rows by 100 columns, and integer arithmetic on the keys gives the readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.functions import spectral as S
from pixelweft.schemas import BAND_ORDER, ROLES

SCENE_PIXELS, SCENE_WIDTH = 1500, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: k, scene_id, row, col, eight dn columns, two class columns, target."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    x = orders.selectExpr("k", "c", f"k div {SCENE_PIXELS} as scene_id", f"(k % {SCENE_PIXELS}) div {SCENE_WIDTH} as row", f"k % {SCENE_WIDTH} as col")
    x = x.selectExpr("*", "row + col as t", "((row div 8) * 5 + (col div 10) * 4 + scene_id) % 9 as blk")
    x = x.selectExpr("*", "k % 211 = 0 and blk not in (0, 2, 4, 6) as iso", "k % 97 = 0 as gap_b", "k % 89 = 0 as gap_a")
    x = x.selectExpr(
        "k", "c", "scene_id", "row", "col", "blk",
        "if(gap_b, 0, 300 + t) as dn_b_b02", "if(gap_b, 0, 400 + t) as dn_b_b03", "if(gap_b, 0, 500 + t) as dn_b_b04", "if(gap_b, 0, 3000 + t) as dn_b_b08",
        "if(gap_a, 0, 300 + t + if(blk in (0, 2), 100, 0)) as dn_a_b02", "if(gap_a, 0, 400 + t) as dn_a_b03",
        "if(gap_a, 0, case when blk = 0 or iso then 1200 + t when blk = 2 then 1000 + t when blk = 6 then 700 + t when blk = 4 then 100 else 500 + t + c % 40 end) as dn_a_b04",
        "if(gap_a, 0, case when blk = 0 or iso then 800 + t when blk = 2 then 2800 + t when blk = 6 then 2700 + t when blk = 4 then 5000 + t else 3000 + t + c % 40 end) as dn_a_b08",
        "cast(blk in (0, 2) as int) as target",
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("has_line", F.lit(True))
    # readings are worked out below the join, so that what stands above it sees plain columns
    return x.join(lines, "k", "left").selectExpr(
        "k", "scene_id", "row", "col", "blk", *(f"dn_{r}_{b.lower()}" for r in ("b", "a") for b in BAND_ORDER),
        "cast(case when has_line is null then 0 when blk = 8 then 3 when c % 11 = 0 then 5 when c % 13 = 0 then 6 else 4 end as int) as scl_before",
        "cast(case when has_line is null then 0 when blk = 7 then 9 when k % 83 = 0 then 7 when blk = 0 then 5 when blk = 2 and c % 7 = 0 then 6 when c % 17 = 0 then 4 when c % 11 = 0 then 5 when c % 13 = 0 then 6 else 4 end as int) as scl_after",
        "target",
    )


def wide(dn: DataFrame) -> DataFrame:
    """dn columns cleaned and turned into reflectance."""
    bands = [S.reflectance(S.clean_dn(f"dn_{r}_{b.lower()}")).alias(f"{r}_{b.lower()}") for r in ("b", "a") for b in BAND_ORDER]
    rest = [c for c in dn.columns if not c.startswith("dn_")]
    return dn.select(*rest, *bands)


def long(dn: DataFrame) -> DataFrame:
    """The readings of dn columns as rows."""
    parts = [F.struct(F.lit(role).alias("role"), F.lit(band).alias("band"), F.col(f"dn_{role[0]}_{band.lower()}").cast("int").alias("dn")) for role in ROLES for band in BAND_ORDER]
    return dn.select("scene_id", "row", "col", F.explode(F.array(*parts)).alias("p")).select("scene_id", "p.role", "p.band", "row", "col", "p.dn")


def from_long(pixels: DataFrame, meta: DataFrame | None = None, nodata: int = 0) -> DataFrame:
    """Long readings to wide reflectance in one shuffle: scene, row, col and eight columns.

    With ``meta`` (scene_id, role, band, nodata) each band has its own nodata; it is one row a band.
    """
    rows = pixels.join(meta.select("scene_id", "role", "band", "nodata"), ["scene_id", "role", "band"], "left") if meta is not None else pixels.withColumn("nodata", F.lit(nodata))
    x = S.reflectance(S.clean_dn("dn", F.col("nodata")))
    cells = [F.max(F.when((F.col("role") == role) & (F.col("band") == band), x)).alias(f"{role[0]}_{band.lower()}") for role in ROLES for band in BAND_ORDER]
    return rows.groupBy("scene_id", "row", "col").agg(*cells)


def with_indexes(px: DataFrame, policy_classes=None, threshold: float = 0.2) -> DataFrame:
    """Adds valid_before, valid_after, valid, ndvi_before, ndvi_after, ndvi_diff and change (valid loss of at least ``threshold``)."""
    from pixelweft.schemas import STRICT

    classes = policy_classes or STRICT
    side = lambda r, scl: S.all_present(*(f"{r}_{b.lower()}" for b in BAND_ORDER)) & S.usable_class(scl, classes)
    x = px.withColumn("valid_before", side("b", "scl_before")).withColumn("valid_after", side("a", "scl_after")).withColumn("valid", F.col("valid_before") & F.col("valid_after"))
    x = x.withColumn("ndvi_before", S.ndvi("b_b08", "b_b04", "valid")).withColumn("ndvi_after", S.ndvi("a_b08", "a_b04", "valid"))
    x = x.withColumn("ndvi_diff", S.difference("ndvi_before", "ndvi_after"))
    return x.withColumn("change", F.col("valid") & F.coalesce(F.col("ndvi_diff") <= -threshold, F.lit(False)))


_STORES: dict[tuple, str] = {}


def modified(spark: SparkSession, file: str) -> int:
    """When a file was written, in milliseconds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def pixel_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair pixels of a folder as a Parquet table, written once in a session and then scanned, so
    that column pruning and pushed filters reach reflectance and classes like any other columns."""
    from pixelweft.storage import durable

    readings = wide(order_pixels(spark, sf_dir))
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted((f, modified(spark, f)) for f in readings.inputFiles())))
    if key not in _STORES:
        _STORES[key] = durable(readings, "pixels").inputFiles()[0].rsplit("/", 1)[0]
    return spark.read.schema(readings.schema).parquet(_STORES[key])


def pairs(spark: SparkSession, sf_dir: str, classes=None) -> DataFrame:
    return with_indexes(pixel_store(spark, sf_dir), classes)
