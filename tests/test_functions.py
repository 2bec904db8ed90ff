import pytest
from pyspark.sql import functions as F

from pixelweft.functions import spectral as S


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_reflectance_and_nodata(spark):
    assert values(spark, [(0,), (5000,), (10000,), (20000,), (None,)], "dn int", S.reflectance("dn")) == [0.0, 0.5, 1.0, 1.0, None]
    rows = [(0.0,), (100.0,), (None,), (-5.0,), (float("nan"),), (float("inf"),)]
    assert values(spark, rows, "dn double", S.clean_dn("dn")) == [None, 100.0, None, None, None, None]


def test_ndvi(spark):
    rows = [(3000.0, 1000.0), (500.0, 500.0), (0.0, 0.0), (None, 1.0)]
    assert values(spark, rows, "n double, r double", S.ndvi("n", "r")) == [0.5, 0.0, None, None]


def test_difference_thresholds_are_inclusive(spark):
    from pixelweft.operators.stats import change_areas

    rows = [(1, 0.8, 0.5), (1, 0.5, 0.45), (1, 0.2, 0.55), (1, None, 0.9)]
    x = spark.createDataFrame(rows, "s int, b double, a double").withColumn("ndvi_diff", F.round(S.difference("b", "a"), 6))
    r = change_areas(x, ["s"]).first()
    assert (r["valid_pixels"], r["loss_01_pixels"], r["gain_01_pixels"], r["loss_03_pixels"], r["gain_03_pixels"]) == (3, 1, 1, 1, 1)


def test_classes(spark):
    rows = [(4.0,), (42.0,), (4.5,), (None,), (float("nan"),)]
    assert values(spark, rows, "c double", S.usable_class("c")) == [True, False, False, False, False]
    assert values(spark, [(4,), (42,)], "c int", S.class_name("c")) == ["vegetation", "unknown_class_42"]
    assert values(spark, [(300.0,), (-2.0,), (3.6,), (None,)], "c double", S.class_code("c")) == [255, 0, 4, 0]
    with pytest.raises(ValueError):
        S.usable_class("c", [])


def test_change_mask(spark):
    rows = [(0.5, True), (0.51, True), (None, True), (0.9, False)]
    assert values(spark, rows, "p double, v boolean", S.change_mask("p", "v", 0.5)) == [0, 1, 255, 255]
    with pytest.raises(ValueError):
        S.change_mask("p", "v", 1.5)


def test_wkt(spark):
    x = values(spark, [(73.75, 18.45, 73.95, 18.6)], "a double, b double, c double, d double", S.bbox_wkt("a", "b", "c", "d"))[0]
    assert x.startswith("POLYGON((73.75 18.45, 73.95 18.45")
