"""Writing layers, documents, features, models and file records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.functions.spectral import class_name
from pixelweft.schemas import BAND_ORDER, FEATURE_NAMES
from pixelweft.storage import shared_dir


#: Spark setting: tasks that list folders, at most.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def layer(rows: DataFrame, path: str, partition: str = "scene_id", tile: int = 256) -> None:
    """Pixels by scene, tiled and sorted so that row-group statistics prune windows. A scene's files cost more than its bytes, so Spark doesn't choose the number of tasks by bytes."""
    x = rows.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
    x.repartition(_tasks(rows), partition, "tile_row").sortWithinPartitions(partition, "tile_row", "tile_col", "row", "col").write.mode("overwrite").partitionBy(partition).parquet(path)


def reflectance_stack(px: DataFrame, path: str, role: str = "b") -> None:
    """Four bands of one date; invalid becomes 0, as files have no NULL."""
    layer(px.select("scene_id", "row", "col", *(F.coalesce(f"{role}_{b.lower()}", F.lit(0.0)).cast("float").alias(b) for b in BAND_ORDER)), path)


def class_layer(px: DataFrame, path: str, scl: str = "scl") -> None:
    layer(px.select("scene_id", "row", "col", F.coalesce(scl, F.lit(0)).cast("short").alias("class"), class_name(F.coalesce(scl, F.lit(0))).alias("name")), path)


def ndvi_layer(px: DataFrame, path: str, column: str = "ndvi_diff") -> None:
    layer(px.select("scene_id", "row", "col", F.col(column).cast("float").alias(column, metadata={"comment": "(nir - red) / (nir + red)"})), path)


def change_layers(scored: DataFrame, path: str) -> None:
    layer(scored.select("scene_id", "row", "col", F.col("change_prob").cast("float").alias("change_prob"), F.coalesce("change_mask", F.lit(255)).cast("short").alias("change_mask")), path)


def bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int = 32) -> DataFrame:
    """A table in the shared folder, bucketed and sorted by ``keys``, as which it is read back: joins of such tables on the keys need no exchange.

    ``buckets`` must be the same for tables that are to meet; at 128 MB a bucket, one for each 128 MB of the largest.
    """
    spark, table = rows.sparkSession, f"pixelweft_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/pixelweft/{uuid.uuid4().hex}/{name}"
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def raw_bands(pixels: DataFrame, path: str) -> None:
    layer(pixels, path)


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, bytes, sha256) of the files under a folder. Folders are listed by as many tasks as a shuffle has, not by one for each."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    try:
        x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    finally:
        spark.conf.set(_LISTING, before)
    return x.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def document(rows: DataFrame, path: str) -> None:
    """One JSON object for each row."""
    rows.write.mode("overwrite").json(path)


def texts(rows: DataFrame, path: str) -> None:
    """A file of its own for each row (value), all in one folder. The number of tasks is set, since Spark would put small rows, and so all the files, into one."""
    rows.repartition(_tasks(rows), F.xxhash64("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def features_csv(vectors: DataFrame, path: str) -> None:
    """sample_id, 25 features with six decimals, priority_int and priority_label."""
    six = [F.format_string("%.6f", F.col(n)).alias(n) for n in FEATURE_NAMES]
    vectors.select("sample_id", *six, "priority_int", "priority_label").write.mode("overwrite").csv(path, header=True)


def model(fitted, path: str, metadata: DataFrame | None = None) -> None:
    fitted.write().overwrite().save(path)
    if metadata is not None:
        document(metadata, f"{path}-metadata")
