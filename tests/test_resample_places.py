"""Rasters in another system: where the cells lie is worked out by many tasks, in arrays."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweft.operators import grid, resample
from pixelweft.storage import durable

SYSTEMS = ("EPSG:4326", "EPSG:32643", "EPSG:32644", "EPSG:32743", "EPSG:3857")


def _rasters(spark, crs="EPSG:32643", s_crs="EPSG:4326", width=70, height=50):
    x = spark.createDataFrame([(k, crs, 10.0, 500003.0 + k, -10.0, 2000041.0, width, height) for k in range(6)], "k long, crs string, a double, c double, e double, f double, width int, height int")
    source = {"s_crs": F.lit(s_crs), "s_a": F.lit(1e-4), "s_c": F.lit(75.0), "s_e": F.lit(-1e-4), "s_f": F.lit(18.09), "s_width": F.lit(90), "s_height": F.lit(60)}
    return x.withColumns(source)


@pytest.mark.parametrize("kernel, sized", [("nearest", False), ("bilinear", True)])
def test_cells_are_dealt_to_many_tasks(spark, kernel, sized):
    """Before, the small table of rasters was read by one task, which worked out the cells of all of them."""
    rasters = durable(_rasters(spark).coalesce(1), "rasters")
    assert rasters.rdd.getNumPartitions() == 1
    px = spark.range(0).selectExpr("id as k", "0 as row", "0 as col", "0.0D as dn")
    plan = resample._gathered(px, rasters, ["k"], kernel, "dn")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "RepartitionByNum".lower() in plan.lower().replace("_", "")
    per_task = [r["count"] for r in resample._places(rasters, ["k"]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) == 4 and sum(per_task) == 6 * 70 * 50 and max(per_task) < 3 * 70 * 50
    assert ("zc" in resample._places(rasters, ["k"], sized).columns) == sized


def test_every_cell_once(spark):
    rows = resample._places(_rasters(spark, width=7, height=3), ["k"]).collect()
    assert sorted((r["k"], r["row"], r["col"]) for r in rows) == [(k, i, j) for k in range(6) for i in range(3) for j in range(7)]
    # rasters in a system that isn't known keep their cells, without a place
    lost = resample._places(_rasters(spark, s_crs="EPSG:3857", width=7, height=3), ["k"]).collect()
    assert len(lost) == 6 * 3 * 7 and all(r["fc"] is None and r["fr"] is None for r in lost)
    assert resample._places(_rasters(spark, width=0, height=0), ["k"]).count() == 0


def test_arrays_are_the_columns(spark):
    points = [(s, t, *((75.0 + i / 50, -9.0 + i) if s == "EPSG:4326" else (400000.0 + 20000 * i, 1900000.0 + 30000 * i))) for s in SYSTEMS for t in SYSTEMS for i in range(10) if s != t]
    x = spark.createDataFrame(points, "s string, t string, x double, y double")
    both = grid.projected(x, "x", "y", "s", "t").withColumns({**grid.system("s", "s_"), **grid.system("t", "t_")}).toPandas()
    systems = [tuple(both[f"{p}{c}"].to_numpy() for c in ("lonlat", "zone", "north")) for p in ("s_", "t_")]
    got = grid.projected_arrays(both["x"].to_numpy(), both["y"].to_numpy(), *systems)
    known = ((both["s"] != "EPSG:3857") & (both["t"] != "EPSG:3857")).to_numpy()
    assert known.sum() == 120 and np.isfinite(got[0][known]).all()
    assert both.loc[~known, "px"].isna().all()
    for a, b in zip(got, (both["px"], both["py"])):
        assert np.isnan(a[~known]).all()
        np.testing.assert_allclose(a[known], b[known], rtol=1e-12, atol=1e-9)


def test_wide_rows_are_cut(spark, monkeypatch):
    """A batch of raster rows is worked on so many cells at a time, whatever their width."""
    one = {"row": 0, "width": 40, "a": 10.0, "s_a": 1e-4, "c": 500003.0, "s_c": 75.0, "e": -10.0, "s_e": -1e-4, "f": 2000041.0, "s_f": 18.09, "lonlat": False, "zone": 43.0, "north": 0.0, "s_lonlat": True, "s_zone": None, "s_north": 0.0}
    batch = pa.RecordBatch.from_pylist([{"k": k} | one | {"row": i, "width": w} for k in range(2) for i, w in enumerate((40, 3, 25))], schema=pa.schema([("k", pa.int64()), *((c, pa.int32() if isinstance(v, int) and not isinstance(v, bool) else pa.bool_() if isinstance(v, bool) else pa.float64()) for c, v in one.items())]))
    whole = [r for b in resample._placed(batch, ["k"], True) for r in b.to_pylist()]
    monkeypatch.setattr(resample, "CELLS", 7)
    parts = list(resample._placed(batch, ["k"], True))
    assert len(parts) > 10 and max(b.num_rows for b in parts) <= 7 and [r for b in parts for r in b.to_pylist()] == whole
    assert [(r["k"], r["row"], r["col"]) for r in whole] == [(k, i, j) for k in range(2) for i, w in enumerate((40, 3, 25)) for j in range(w)]
