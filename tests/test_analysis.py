import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from pixelweft.operators import analysis, change, features, ledger, priority
from pixelweft.sources import labelled
from tests.test_operators import block_pixels


def test_requests_to_results(spark):
    rows = [(k, 70.0, 70.2, 18.0, 18.1, dt.date(2024, 1, 1), dt.date(2024, 5, 1), 0.5, "strict", 10.0) for k in ("a", "b")]
    rows.append(("bad", 71.0, 70.2, 18.0, 18.1, dt.date(2024, 1, 1), dt.date(2024, 5, 1), 0.5, "strict", 10.0))
    requests = spark.createDataFrame(rows, "analysis_id string, min_lon double, max_lon double, min_lat double, max_lat double, before_date date, after_date date, change_threshold double, scl_policy string, pixel_resolution_m double")
    scenes = spark.createDataFrame([("a", "before"), ("a", "after"), ("b", "before")], "analysis_id string, role string")
    px = block_pixels(spark, 40, 10, 20).withColumn("scene_id", F.lit("a"))
    labelled = features.rule_label(features.vector(features.extract(px.unionByName(px.withColumn("scene_id", F.lit("z")))), ["scene_id"]))
    got = {r["analysis_id"]: r for r in analysis.analyse(requests, scenes, px, priority.fit(labelled, trees=3)).collect()}
    assert set(got) == {"a", "b", "bad"} and got["a"]["status"] == "complete" and got["b"]["status"] == "no_data"
    assert got["bad"]["status"] == "failed" and got["bad"]["error"].startswith("refused: ") and got["bad"]["aoi"]["min_lon"] == 71.0 and got["bad"]["observations"] is None
    assert [o["role"] for o in got["a"]["observations"]] == ["before", "after"] and got["a"]["artifacts"]["change_mask"] == "/artifacts/a/change_mask.tif"
    assert got["a"]["change"]["changed_pixels"] == 121 and got["a"]["priority"]["priority"] == labelled.first()["priority_label"] and got["b"]["change"] is None


def test_training_picks_the_best(spark):
    px = None
    for s in range(3):
        x = block_pixels(spark, 24, 4 + s, 12 + s).withColumn("scene_id", F.lit(f"s{s}")).withColumn("target", F.col("change").cast("int"))
        px = x if px is None else px.unionByName(x)
    model, history = analysis.train(px, grid_=[{"reg": 0.5, "max_iter": 2}, {"reg": 0.001}])
    assert history.count() == 2
    scored, stats = analysis.infer(px, lambda p: change.score(p, model))
    assert change.confusion(scored, []).first()["iou"] > 0.9 and stats.count() == 3


def test_clip(spark):
    px = block_pixels(spark, 20)
    grids = spark.createDataFrame([("s", 10.0, 0.0, 500000.0, 0.0, -10.0, 2000000.0, 20, 20)], "scene_id string, a double, b double, c double, d double, e double, f double, width int, height int")
    boxes = spark.createDataFrame([("s", 500020.0, 1999900.0, 500050.0, 1999980.0)], "scene_id string, minx double, miny double, maxx double, maxy double")
    assert analysis.clip(px, grids, boxes).count() == 3 * 8


def _results(spark, ids, status="complete"):
    item = {"role": "before", "item_id": "B", "acquired": dt.date(2024, 1, 1), "cloud_cover_percent": 1.0, "crs": "EPSG:32643"}
    schema = """analysis_id string, status string, error string, finished_at timestamp, aoi struct<min_lon double, min_lat double, max_lon double, max_lat double>,
      observations array<struct<role string, item_id string, acquired date, cloud_cover_percent double, crs string>>, change struct<total_pixels long, valid_pixels long, changed_pixels long, changed_area_ha double, change_fraction double, threshold double>,
      artifacts struct<change_probability string, change_mask string, inference_summary string, change_geojson string>"""
    rows = [(i, status, None, dt.datetime(2024, 6, 1), (70.0, 18.0, 70.2, 18.1), [item], (10, 9, 1, 0.01, 0.1, 0.5), ("/a/p.tif", "/a/m.tif", None, None)) for i in ids]
    empty = features.extract(block_pixels(spark, 10, 2, 4)).drop("scene_id")
    summary = F.lit(None).cast(empty.schema.simpleString())
    return spark.createDataFrame(rows, schema).withColumns({"summary": summary, "priority": F.lit(None).cast(analysis.PRIORITY)})


def _created(spark, folder, ids):
    ledger.create_runs(spark.createDataFrame([(i, dt.datetime(2024, 5, 1), ("x",)) for i in ids], "analysis_id string, created_at timestamp, parameters struct<p string>"), folder)


def test_two_finishes_at_the_same_time(spark, tmp_path, monkeypatch):
    """Both have seen the run open and written their rows before either enters the log: one wins, and nothing is there twice."""
    folder = str(tmp_path / "ledger")
    _created(spark, folder, ["r", "other", "third"])
    gate, take = threading.Barrier(2, timeout=120), ledger._take
    first = threading.local()

    def together(*args):
        if not getattr(first, "passed", False):
            first.passed = True
            gate.wait()
        return take(*args)

    monkeypatch.setattr(ledger, "_take", together)
    outcome = {}

    def finish(name, ids):
        try:
            ledger.finish_runs(_results(spark, ids), folder)
            outcome[name] = "won"
        except ValueError as e:
            outcome[name] = str(e)

    racers = [threading.Thread(target=finish, args=(n, ids)) for n, ids in (("a", ["r", "other"]), ("b", ["r", "third"]))]
    [t.start() for t in racers]
    [t.join() for t in racers]
    assert sorted(v == "won" for v in outcome.values()) == [False, True] and any("finished already: 1" in v for v in outcome.values())
    monkeypatch.setattr(ledger, "_take", take)
    states = {r["analysis_id"]: r["status"] for r in ledger.latest(ledger.read(spark, folder, "runs")).collect()}
    loser = "third" if outcome["a"] == "won" else "other"
    assert states == {"r": "complete", "other": "complete", "third": "complete"} | {loser: "running"}
    for name, n in (("observations", 2), ("change_detections", 2), ("artifacts", 4), ("aois", 2)):
        assert ledger.read(spark, folder, name).count() == n, name
    # what lost may try again without the run that it lost
    ledger.finish_runs(_results(spark, [loser], "failed"), folder)
    assert ledger.latest(ledger.read(spark, folder, "runs")).where("status = 'running'").count() == 0
    with pytest.raises(ValueError, match="finished already: 1"):
        ledger.finish_runs(_results(spark, [loser]), folder)
    with pytest.raises(ValueError, match="unknown runs: 1"):
        ledger.finish_runs(_results(spark, ["nobody"]), folder)


def test_finishes_of_different_runs_both_count(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    _created(spark, folder, ["a", "b"])
    racers = [threading.Thread(target=ledger.finish_runs, args=(_results(spark, [i]), folder)) for i in "ab"]
    [t.start() for t in racers]
    [t.join() for t in racers]
    assert ledger.latest(ledger.read(spark, folder, "runs")).where("status = 'complete'").count() == 2 and ledger.read(spark, folder, "observations").count() == 2


def test_rows_of_a_crashed_finish_are_not_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "ledger")
    _created(spark, folder, ["a"])

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(ledger, "_take", crash)
        ledger.finish_runs(_results(spark, ["a"]), folder)
    assert ledger.read(spark, folder, "observations").count() == 0 and ledger.read(spark, folder, "runs").first()["status"] == "running"
    ledger.finish_runs(_results(spark, ["a"]), folder)
    assert ledger.read(spark, folder, "observations").count() == 1


def test_labelled_regions(spark):
    """Names in any case, a 20 m band, a missing mask; refused splits; missing files."""
    n, rows, grids = 8, [], []

    def raster(region, folder, filename, base, size=10.0):
        m = int(n * 10 / size)
        grids.append((region, folder, filename, size, 0.0, -size, 0.0, m, m))
        rows.extend((region, folder, filename, r, c, float(base + 3 * r + 7 * c)) for r in range(m) for c in range(m))

    for region, case, nir in (("alpha", str.lower, 10.0), ("Beta", str.upper, 20.0), ("gamma", str, 10.0)):
        for folder, extra in (("imgs_1_rect", 0), ("imgs_2_rect", 100)):
            for band, base in (("B02", 300), ("B03", 400), ("B04", 500)):
                raster(region, folder, case(f"{band}.tif"), base + extra)
            raster(region, folder, case("B08.tif"), 3000 + extra, nir)
        raster(region, "imgs_1", "B02.tif", 9000)  # the other pair of folders is not whole
    rows += [(r, "cm", "cm.PNG", i, j, 255.0 if 2 <= i < 4 and 2 <= j < 4 else 0.0) for r in ("alpha", "Beta") for i in range(n) for j in range(n)]
    rows += [("alpha", "target/cm", "cm.png", i, j, 255.0 if i == 0 else 0.0) for i in range(n) for j in range(n)]  # comes before the other
    px = spark.createDataFrame(rows, "region string, folder string, filename string, row int, col int, value double")
    g = spark.createDataFrame(grids, "region string, folder string, filename string, a double, c double, e double, f double, width int, height int")
    files = px.select("region", "folder", "filename").distinct()
    splits = spark.createDataFrame([("train", "ALPHA"), ("train", "beta"), ("test", " gamma ")], "split string, region string")
    got = {(r["region"], r["row"], r["col"]): r for r in labelled.load(files, px, g, splits, "train").collect()}
    assert {k[0] for k in got} == {"alpha", "Beta"} and len(got) == 2 * n * n
    assert got["alpha", 2, 3]["before_b02"] == pytest.approx(0.0327) and got["alpha", 2, 3]["after_b08"] == pytest.approx((3100 + 6 + 21) / 1e4)
    assert got["Beta", 4, 4]["before_b08"] == pytest.approx((3000 + 10 * 1.75) / 1e4) and got["Beta", 7, 7]["before_b08"] is not None
    assert sum(r["target"] for k, r in got.items() if k[0] == "alpha") == n and sum(r["target"] for k, r in got.items() if k[0] == "Beta") == 4
    held = labelled.load(files, px, g, splits, "test").agg(F.sum("target").alias("t"), F.bool_or("annotated").alias("a"), F.count("*").alias("n")).first()
    assert (held["t"], held["a"], held["n"]) == (0, False, n * n)
    row = lambda *x: spark.createDataFrame(list(x), "split string, region string")
    with pytest.raises(ValueError, match="splits without regions: test"):
        labelled.checked_splits(row(("train", "a"), ("test", " ")))
    with pytest.raises(ValueError, match="more than one split: a"):
        labelled.checked_splits(row(("train", "A"), ("test", "a"), ("test", "b")))
    with pytest.raises(ValueError, match="not there: delta"):
        labelled.load(files, px, g, row(("train", "delta"), ("test", "alpha")), "train")
    with pytest.raises(ValueError, match="gamma/after/B08"):
        labelled.load(files.where("not (region = 'gamma' and folder = 'imgs_2_rect' and filename = 'B08.tif')"), px, g)
