"""Resampling within one system: pixels spread over the cells that they count for."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.operators import align, resample


def _grid(spark, a, c, e, f, width, height):
    return spark.createDataFrame([(1, "EPSG:32643", a, 0.0, c, 0.0, e, f, width, height)], "k long, crs string, a double, b double, c double, d double, e double, f double, width int, height int")


def _pixels(spark):
    return spark.range(30 * 20).selectExpr("1L as k", "cast(id div 30 as int) as row", "cast(id % 30 as int) as col", "if(id % 11 = 0, null, cast(id * 37 % 101 as double)) as dn").where("row != 7 or col > 4")


@pytest.mark.parametrize("kernel, to", [
    ("nearest", (10.0, 3.0, -10.0, 204.0, 31, 21)), ("average", (25.0, -20.0, -25.0, 230.0, 14, 12)), ("lanczos", (4.0, 105.0, -4.0, 140.0, 12, 10)), ("cubic", (10.0, 5.0, 10.0, -5.0, 30, 20)),
])
def test_spread_is_brute_force(spark, kernel, to):
    px, source, target = _pixels(spark), _grid(spark, 10.0, 0.0, -10.0, 200.0, 30, 20), _grid(spark, *to)
    out = resample.resample(px, source, target, ["k"], ["k"], kernel)
    # before, cells and taps were joined with the pixels
    assert not re.search(r"Join \[[^\]]*s[rc]#", out._jdf.queryExecution().executedPlan().toString())
    v = {(r["row"], r["col"]): r["dn"] for r in px.collect() if r["dn"] is not None}
    a, c, e, f, width, height = to
    rows = {(r["row"], r["col"]): r["dn"] for r in out.collect()}
    assert rows.keys() == {(i, j) for i in range(height) for j in range(width)}
    for (i, j), got in rows.items():
        fc, fr = (c + a * (j + 0.5)) / 10 - 0.5, (f + e * (i + 0.5) - 200) / -10 - 0.5
        zc, zr = max(1.0, a / 10), max(1.0, e / -10)
        if (math.floor(fr + 0.5), math.floor(fc + 0.5)) not in v:
            want = None
        elif kernel == "nearest":
            want = v[math.floor(fr + 0.5), math.floor(fc + 0.5)]
        else:
            if kernel == "average":
                weight = lambda at, x, z: float(math.ceil(round(x - z / 2, 6)) <= at < math.ceil(round(x + z / 2, 6)))
            else:
                weight = lambda at, x, z: float(resample.SPREAD[kernel](np.array((at - x) / z)))
            taps = [(weight(q, fc, zc) * weight(r, fr, zr), x) for (r, q), x in v.items()]
            want = sum(w * x for w, x in taps) / sum(w for w, _ in taps)
        assert got == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-9)), (i, j)


def test_small_pieces(spark, monkeypatch):
    """A batch whose pixels count for many cells is worked on piece by piece."""
    px, source, target = _pixels(spark), _grid(spark, 10.0, 0.0, -10.0, 200.0, 30, 20), _grid(spark, 4.0, 5.0, -4.0, 190.0, 40, 30)
    batch = next(iter(px.where("dn is not null").toArrow().combine_chunks().to_batches()))
    import pyarrow as pa

    n = batch.num_rows
    given = {"a": 4.0, "s_a": 10.0, "c": 5.0, "s_c": 0.0, "e": -4.0, "s_e": -10.0, "f": 190.0, "s_f": 200.0, "width": 40, "height": 30, "raster": 5}
    wide = pa.RecordBatch.from_arrays([batch.column("k"), batch.column("row"), batch.column("col"), batch.column("dn"), *(pa.array([v] * n) for v in given.values())], ["k", "sr", "sc", "v", *given])
    whole = [r for b in resample._spread(wide, ["k"], "cubic") for r in b.to_pylist()]
    monkeypatch.setattr(resample, "PAIRS", 1000)
    parts = list(resample._spread(wide, ["k"], "cubic"))
    assert len(parts) > 10 and sum(r["wv"] for b in parts for r in b.to_pylist()) == pytest.approx(sum(r["wv"] for r in whole))


def test_classes_come_with_the_bands(spark):
    """One aggregation brings bands and classes of a cell together: no join on cells."""
    rasters = spark.createDataFrame([(1, r, "EPSG:32643", 10.0, 0.0, c, 0.0, -10.0, 200.0, 30, 20) for r, c in (("before", 0.0), ("after", 20.0))], "scene_id long, role string, crs string, a double, b double, c double, d double, e double, f double, width int, height int")
    meta = rasters.withColumn("band", F.explode(F.array(*(F.lit(b) for b in ("B02", "B03", "B04", "B08"))))).withColumn("nodata", F.lit(0))
    cells = _pixels(spark).drop("k", "dn").crossJoin(rasters.select("scene_id", "role"))
    px = cells.crossJoin(meta.select("band").distinct()).withColumn("dn", F.expr("1000 + row * 10 + col"))
    classes = cells.where("role = 'after'").withColumn("scl", F.expr("if(col = 9, 9, 4)"))
    out, _ = align.prepare_pairs(px, meta, classes, rasters.where("role = 'after'"))
    assert not re.search(r"Join \[[^\]]*row#", out._jdf.queryExecution().executedPlan().toString())
    rows = out.collect()
    assert len(rows) == 28 * 20 and not any(r["scl_before_available"] for r in rows) and all(r["scl_after_available"] for r in rows)
    at = {(r["row"], r["col"]): r for r in rows}
    assert at[3, 9]["scl_after"] == 9 and at[3, 8]["scl_after"] == 4 and at[7, 2]["scl_after"] == 0 and at[3, 8]["scl_before"] == 4 and at[3, 8]["b_b02"] == pytest.approx(0.104)
