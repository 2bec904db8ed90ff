"""Loading observations, provenance, split files and labelled features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.functions import spectral as S
from pixelweft.operators.features import decode, encode
from pixelweft.schemas import BAND_META, FEATURE_NAMES, PIXELS_LONG


def readings(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixel readings; with a window (row0, row1, col0, col1, half open) the filter reaches the scan."""
    x = spark.read.schema(PIXELS_LONG).parquet(path)
    if window:
        r0, r1, c0, c1 = window
        x = x.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return x


def band_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAND_META).parquet(path)


def as_float(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Readings as float, NULL for nodata. ``meta`` has one row a raster."""
    keys = ["scene_id", "role", "band"]
    return pixels.join(meta.select(*keys, "nodata"), keys).withColumn("dn", F.nullif(F.col("dn").cast("float"), F.col("nodata").cast("float"))).drop("nodata")


def classes(pixels: DataFrame, value: str = "dn") -> DataFrame:
    return pixels.withColumn("scl", S.class_code(value)).drop(value)


def provenance(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Acquisition documents, one JSON object a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def split_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows (split, value) of text files, one for each split."""
    out = None
    for split, path in paths.items():
        x = spark.read.text(path).withColumn("split", F.lit(split))
        out = x if out is None else out.unionByName(x)
    return out


def labelled_features(spark: SparkSession, path: str, label_source: str) -> DataFrame:
    """A CSV of sample_id, 25 features, priority_int and priority_label; either label may be missing."""
    schema = "sample_id string, " + ", ".join(f"{n} double" for n in FEATURE_NAMES) + ", priority_int int, priority_label string"
    x = spark.read.csv(path, schema=schema, header=True)
    x = x.withColumn("priority_int", F.coalesce("priority_int", encode("priority_label"))).withColumn("priority_label", F.coalesce("priority_label", decode("priority_int")))
    x = x.withColumn("sample_id", F.coalesce("sample_id", F.concat(F.lit("sample_"), F.monotonically_increasing_id().cast("string"))))
    return x.withColumn("label_source", F.lit(label_source))


def processed(spark: SparkSession, path: str, layers: list[str]) -> DataFrame:
    """A processed scene table; layers that it lacks are NULL."""
    x = spark.read.parquet(path)
    return x.withColumns({c: F.lit(None).cast("double") for c in layers if c not in x.columns})


def forest(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
