"""Catalogues, requests, splits and runs derived from the driver's orders by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.sources.pixels import table


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as c", "cast(o_orderdate as date) as d", "cast(o_orderdate as timestamp) as ts", "o_orderstatus as status", "o_totalprice as price")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orders(spark, sf_dir).selectExpr("*", "70 + (k % 50) / 10.0D as min_lon", "18 + (k % 30) / 10.0D as min_lat")
    return x.selectExpr(
        "concat('run-', k) as analysis_id", "min_lon", "min_lon + if(k % 17 = 0, -1, 2) / 10.0D as max_lon", "min_lat", "min_lat + if(k % 19 = 0, -1, 1) / 10.0D as max_lat",
        "d as before_date", "date_add(d, cast(if(k % 23 = 0, 0, 30 + k % 100) as int)) as after_date", "(k % 13) / 10.0D as change_threshold",
        "case when k % 29 = 0 then 'loose' when k % 2 = 0 then 'strict' else 'lenient' end as scl_policy", "if(k % 31 = 0, 0.0D, 10.0D) as pixel_resolution_m",
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).selectExpr(
        "concat('S', k) as item_id", "c % 40 as aoi", "if(k % 2 = 0, 'before', 'after') as role", "ts", "cast((k * 37) % 101 as double) as cloud_cover_percent", "concat('T', k % 7) as tile",
        "map_filter(map('B02', 'b02', 'B03', 'b03', 'B04', 'b04', 'B08', if(k % 9 = 0, null, 'b08')), (n, v) -> v is not null) as assets",
        "named_struct('minx', cast(c % 90 as double), 'miny', cast(c % 45 as double), 'maxx', cast(c % 90 + 10 as double), 'maxy', cast(c % 45 + 10 as double)) as bbox",
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 10 m grid for the before date and a shifted one for the after date of each scene."""
    s = orders(spark, sf_dir).selectExpr("k div 1500 as scene_id").distinct()
    b = s.selectExpr("scene_id", "'before' as role", "'EPSG:32643' as crs", "10.0D as a", "0.0D as b", "500000.0D + 10 * (scene_id % 7) as c", "0.0D as d", "-10.0D as e", "2000000.0D as f", "100 as width", "15 as height")
    a = s.selectExpr("scene_id", "'after' as role", "'EPSG:32643' as crs", "10.0D as a", "0.0D as b", "500050.0D as c", "0.0D as d", "-10.0D as e", "1999970.0D - 3 * (scene_id % 5) as f", "100 as width", "15 as height")
    return b.unionByName(a)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files in three folders, not all in every folder."""
    found = F.expr("filter(array(if(k % 5 != 0, 'A', null), if(k % 7 != 0, 'B', null), if(k % 11 != 0, 'label', null)), p -> p is not null)")
    return orders(spark, sf_dir).select(F.concat(F.lit("tile_"), F.col("k").cast("string")).alias("stem"), F.explode(found).alias("part"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).selectExpr("if(status = 'F', 'train', 'test') as split", "concat('r', c % 500) as region").distinct()
