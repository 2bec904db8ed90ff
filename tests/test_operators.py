import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.operators import align, catalog, change, datasets, explain, features, grid, ledger, masking, patches, preprocess, priority, ranking, resample, stats, validate
from pixelweft.schemas import FEATURE_NAMES
from pixelweft.sources import pixels, readers, sinks


def block_pixels(spark, n=100, lo=20, hi=39):
    """A block that lost its vegetation: NDVI 0.65 to 0.2, class 4 to 5."""
    x = spark.range(n * n).select(F.lit("s").alias("scene_id"), F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    inside = F.col("row").between(lo, hi) & F.col("col").between(lo, hi)
    cols = {f"{r}_{b}": F.when(inside & F.lit(r == "a"), after).otherwise(before) for r in ("b", "a") for b, before, after in (("b02", 0.05, 0.05), ("b03", 0.06, 0.06), ("b04", 0.05, 0.20), ("b08", 0.40, 0.15))}
    x = x.withColumns(cols).withColumns({"scl_before": F.lit(4), "scl_after": F.when(inside, 5).otherwise(4), "valid_before": F.lit(True), "valid_after": F.lit(True), "valid": F.lit(True)})
    x = x.withColumns({"ndvi_before": F.lit(0.65), "ndvi_after": F.when(inside, 0.20).otherwise(0.65), "change": inside})
    return x.withColumn("ndvi_diff", F.col("ndvi_after") - F.col("ndvi_before"))


def test_loss_signal(spark):
    r = features.extract(block_pixels(spark)).first()
    assert (r["changed_pixels"], r["changed_area_ha"], r["veg_loss_ha_02"], r["veg_loss_ha_03"], r["scl_veg_loss_ha"]) == (400, 4.0, 4.0, 4.0, 4.0)
    assert (r["change_ndvi_diff_mean"], r["delta_b04_mean"], r["delta_b08_mean"]) == (-0.45, 0.15, -0.25)
    assert (r["patch_count"], r["max_patch_area_ha"], r["patch_sizes_ha"], r["patch_density_per_km2"]) == (1, 4.0, [4.0], 1.0)


@pytest.mark.parametrize("tile", [patches.TILE, (16, 16), (1, 1)])
def test_patches(spark, tile):
    cells = [(r, c) for r in range(10, 20) for c in range(10, 20)] + [(r, c) for r in range(40, 60) for c in range(40, 60)] + [(80, 80), (81, 81)]
    x = spark.createDataFrame([("s", r, c) for r, c in cells], "scene_id string, row int, col int")
    labelled = patches.label(patches.runs(x), tile)
    r = patches.patch_stats(patches.patch_sizes(labelled)).first()
    assert (r["patch_count"], r["mean_patch_area_ha"], r["max_patch_area_ha"], r["large_patch_count"], r["patch_sizes_ha"]) == (2, 2.5, 4.0, 2, [4.0, 1.0])
    assert labelled.select("patch").distinct().count() == 3  # diagonal neighbours are one


@pytest.mark.parametrize("tile", [patches.TILE, (4, 7), (1, 64), (64, 1)])
def test_patches_of_noise(spark, tile):
    """Tiles of any shape, down to a row or a column, against a flood over the cells."""
    rng = np.random.default_rng(3)
    cells = [(s, int(r), int(c)) for s in range(3) for r, c in zip(*np.nonzero(rng.random((40, 40)) < 0.4), strict=True)]
    todo, want = set(cells), []
    while todo:
        stack, n = [todo.pop()], 0
        scene = stack[0][0]
        while stack:
            s, r, c = stack.pop()
            n += 1
            near = {(s, r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & todo
            todo -= near
            stack += near
        want.append((scene, n))
    found = patches.runs(spark.createDataFrame(cells, "scene_id int, row int, col int"))
    labelled = patches.label(found, tile)
    got = labelled.groupBy("scene_id", "patch").agg(F.sum("len").alias("n"))
    assert sorted((r["scene_id"], r["n"]) for r in got.collect()) == sorted(want) and labelled.count() == found.count()
    assert patches.label(found.limit(0), tile).count() == 0


@pytest.mark.parametrize(("bins", "sort"), [(ranking.BINS, ranking.SORTED), (4, 3), (2, 0)])
def test_medians(spark, bins, sort):
    """Even and odd groups, ties, one value, infinite and missing values, far outliers, a null group; bins so few that many passes are needed."""
    rng = np.random.default_rng(8)
    inf = float("inf")
    groups = {"even": rng.normal(0, 1, 400), "odd": rng.normal(5, 0.001, 301), "ties": rng.integers(0, 3, 100).astype(float), "one": [7.0], "two": [1.0, 4.0], None: [2.0, 2.0, 9.0], "inf": [-inf, -inf, 1.0, inf, inf], "tail": [*rng.random(50), 1e300], "low": [-inf, 3.0, 5.0, 6.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("nothing", None), ("odd", float("nan"))]
    x = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["median"] for r in ranking.medians(x, ["g"], "v", bins=bins, sort=sort).collect()}
    assert got == {g: float(np.median(np.array(vs))) for g, vs in groups.items()}
    assert ranking.medians(x.limit(0), ["g"], "v").count() == 0
    assert ranking.medians(x.where("g = 'two'"), [], "v").first()["median"] == 2.5


def test_no_change(spark):
    r = features.extract(block_pixels(spark, 10, 50, 60)).first()
    assert (r["changed_pixels"], r["patch_count"], r["patch_sizes_ha"], r["change_ndvi_diff_mean"]) == (0, 0, [], None)
    v = features.vector(features.extract(block_pixels(spark, 10, 50, 60)), ["scene_id"]).first()
    assert v["change_ndvi_diff_mean"] == 0.0 and len(FEATURE_NAMES) == 25


def test_mask_report(spark):
    x = spark.createDataFrame([(c,) for c in (4, 4, 5, 9, 0, 42, None)], "scl int")
    r = masking.mask_report(x, []).first()
    assert (r["pixels"], r["usable_pixels"], r["cloud_pixels"], r["no_data_pixels"], r["unknown_classes"]) == (7, 3, 1, 1, [42])
    h = {r["class"]: (r["pixels"], r["name"]) for r in masking.class_histogram(x.withColumn("k", F.lit(1)), ["k"]).collect()}
    assert h[4] == (2, "vegetation") and h[None] == (1, "non_finite") and h[42][1] == "unknown_class_42"


def test_rule_labels(spark):
    rows = {"LOW": {"changed_area_ha": 0.2}, "MEDIUM": {"changed_area_ha": 4.5, "veg_loss_ha_02": 2.5, "large_patch_count": 1.0}, "HIGH": {"changed_area_ha": 15.0, "veg_loss_ha_02": 12.0, "large_patch_count": 4.0}}
    x = spark.createDataFrame([(k, *(float(v.get(n, 0.0)) for n in FEATURE_NAMES)) for k, v in rows.items()], "sample_id string, " + ", ".join(f"{n} double" for n in FEATURE_NAMES))
    assert {r["sample_id"]: r["priority_label"] for r in features.rule_label(x).collect()} == {k: k for k in rows}


def test_metrics(spark):
    rows = [(1, 1), (0, 1), (1, 0), (0, 0), (255, 1)]
    x = change.confusion(spark.createDataFrame(rows, "change_mask int, target int"), []).first()
    assert (x["tp"], x["fp"], x["fn"], x["tn"], x["precision"], x["f1"], x["iou"]) == (1, 1, 1, 1, 0.5, 0.5, round(1 / 3, 6))
    empty = change.confusion(spark.createDataFrame([(0, 0)], "change_mask int, target int"), []).first()
    assert (empty["accuracy"], empty["f1"], empty["iou"]) == (1.0, 0.0, 0.0)


def test_utm(spark):
    aoi = spark.createDataFrame([(73.79, 18.53, 10240.0, 10.0, "EPSG:32643")], "lon double, lat double, edge_m double, res double, crs string")
    r = grid.aoi_lonlat(grid.aoi_bounds(aoi)).first()
    assert (r["minx"], r["miny"], r["maxx"], r["maxy"]) == (367160, 2044130, 377400, 2054370)
    x, y = grid.utm_from_lonlat("lon", "lat", grid.utm_zone("crs"))
    back = aoi.withColumn("x", x).withColumn("y", y)
    lon, lat = grid.lonlat_from_utm("x", "y", grid.utm_zone("crs"))
    b = back.select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(b["lon"] - 73.79) < 1e-9 and abs(b["lat"] - 18.53) < 1e-9


def meta(spark, rows):
    return spark.createDataFrame(rows, "scene_id long, role string, band string, crs string, a double, b double, c double, d double, e double, f double, width int, height int, nodata int")


def synthetic_pair(spark, dx=0.0, dy=0.0):
    """64 x 64 cells of 10 m; the after date lost vegetation in a block on the ground, and may lie shifted."""
    n, x0, y0 = 64, 500000.0, 2000000.0
    base = {"B02": 300, "B03": 400, "B04": 500, "B08": 3000}
    rows, metas = [], []
    for role, ox, oy in (("before", 0.0, 0.0), ("after", dx, dy)):
        for band, v in base.items():
            metas.append((1, role, band, "EPSG:32643", 10.0, 0.0, x0 + ox, 0.0, -10.0, y0 + oy, n, n, 0))
            for r in range(n):
                for c in range(n):
                    gx, gy = x0 + ox + 10 * (c + 0.5), y0 + oy - 10 * (r + 0.5)
                    lost = role == "after" and 500200 <= gx < 500320 and 1999680 < gy <= 1999800
                    t = r + c
                    rows.append((1, role, band, r, c, {"B08": 800 + t, "B04": 1200 + t}.get(band, v + t) if lost else v + t))
    return spark.createDataFrame(rows, pixels_schema()), meta(spark, metas)


def pixels_schema():
    from pixelweft.schemas import PIXELS_LONG

    return PIXELS_LONG


@pytest.mark.parametrize(("dx", "dy", "size"), [(0.0, 0.0, (64, 64)), (50.0, -30.0, (59, 61))])
def test_shifted_pair_coregisters(spark, dx, dy, size):
    px, grids = align.prepare_pairs(*synthetic_pair(spark, dx, dy))
    g = grids.first()
    assert (g["width"], g["height"], g["c"], g["f"]) == (*size, 500000.0 + dx, 2000000.0 + dy)
    x = F.lit(g["c"]) + 10 * (F.col("col") + 0.5)
    y = F.lit(g["f"]) - 10 * (F.col("row") + 0.5)
    inside = (x >= 500200) & (x < 500320) & (y > 1999680) & (y <= 1999800)
    r = px.agg(F.avg(F.when(inside, F.col("change").cast("int"))).alias("i"), F.avg(F.when(~inside, F.col("change").cast("int"))).alias("o"), F.count("*").alias("n")).first()
    assert r["n"] == size[0] * size[1] and r["i"] > 0.95 and r["o"] < 0.01


def test_pair_in_two_reference_systems(spark):
    """The after date in lon/lat: what it lost lies where it would in UTM."""
    n = 64
    box = spark.createDataFrame([(1, 500000.0, 2000000.0 - 640, 500640.0, 2000000.0, "EPSG:32643", "EPSG:4326")], "k int, minx double, miny double, maxx double, maxy double, crs string, to string")
    b = grid.bounds_in(box, "crs", "to", ["k"]).first()
    a, e = (b["maxx"] - b["minx"]) / n, (b["maxy"] - b["miny"]) / n
    metas = [(1, "before", band, "EPSG:32643", 10.0, 0.0, 500000.0, 0.0, -10.0, 2000000.0, n, n, 0) for band in ("B02", "B03", "B04", "B08")]
    metas += [(1, "after", band, "EPSG:4326", a, 0.0, b["minx"], 0.0, -e, b["maxy"], n, n, 0) for band in ("B02", "B03", "B04", "B08")]
    cells = spark.range(n * n).select(F.lit(1).alias("scene_id"), F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    cells = cells.withColumns({"lon": b["minx"] + a * (F.col("col") + 0.5), "lat": b["maxy"] - e * (F.col("row") + 0.5), "ll": F.lit("EPSG:4326"), "utm": F.lit("EPSG:32643")})
    after = grid.projected(cells, "lon", "lat", "ll", "utm", ("gx", "gy")).withColumn("lost", F.col("gx").between(500200, 500320) & F.col("gy").between(1999680, 1999800))
    before = cells.withColumn("lost", F.lit(False))
    bands = F.explode(F.array(*(F.struct(F.lit(n_).alias("band"), F.lit(v).alias("v")) for n_, v in (("B02", 300), ("B03", 400), ("B04", 500), ("B08", 3000))))).alias("p")
    rows = after.select("scene_id", F.lit("after").alias("role"), "row", "col", "lost", bands).unionByName(before.select("scene_id", F.lit("before").alias("role"), "row", "col", "lost", bands))
    value = F.when(F.col("lost") & (F.col("p.band") == "B08"), 800).when(F.col("lost") & (F.col("p.band") == "B04"), 1200).otherwise(F.col("p.v")) + F.col("row") + F.col("col")
    px, grids = align.prepare_pairs(rows.select("scene_id", "role", "p.band", "row", "col", value.alias("dn")), meta(spark, metas), resolution=10.0)
    g = grids.first()
    assert g["crs"] == "EPSG:32643" and g["a"] == 10.0
    x, y = F.lit(g["c"]) + 10 * (F.col("col") + 0.5), F.lit(g["f"]) - 10 * (F.col("row") + 0.5)
    inside = (x >= 500200) & (x < 500320) & (y > 1999680) & (y <= 1999800)
    r = px.agg(F.avg(F.when(inside, (F.col("ndvi_diff") <= -0.2).cast("int"))).alias("i"), F.avg(F.when(~inside, (F.col("ndvi_diff") <= -0.2).cast("int"))).alias("o"), F.count("ndvi_diff").alias("n")).first()
    edge = (x >= 500180) & (x < 500340) & (y > 1999660) & (y <= 1999820)
    far = px.agg(F.max(F.when(~edge, F.abs("ndvi_diff"))).alias("far")).first()["far"]
    assert r["i"] > 0.8 and r["o"] < 0.05 and far < 0.15 and r["n"] > 3500


def test_systems_that_cannot_be_brought_together(spark):
    metas = [(1, "before", "B02", "EPSG:32643", 10.0, 0.0, 500000.0, 0.0, -10.0, 2000000.0, 9, 9, 0), (1, "after", "B02", "EPSG:3857", 10.0, 0.0, 500000.0, 0.0, -10.0, 2000000.0, 9, 9, 0)]
    metas += [(2, r, "B02", "EPSG:3857", 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, 9, 9, 0) for r in ("before", "after")]
    assert [(r["scene_id"], r["crs"], r["width"]) for r in grid.common_grid(meta(spark, metas), ["scene_id"]).collect()] == [(2, "EPSG:3857", 9)]
    zones = [(1, "before", "B02", "EPSG:32643", 10.0, 0.0, 805000.0, 0.0, -10.0, 2000000.0, 900, 900, 0), (1, "after", "B02", "EPSG:32644", 10.0, 0.0, 170000.0, 0.0, -10.0, 2002000.0, 2000, 2000, 0)]
    g = grid.common_grid(meta(spark, zones), ["scene_id"]).collect()
    assert len(g) == 1 and g[0]["crs"] == "EPSG:32643" and g[0]["width"] > 0


def test_preprocessing_refuses_scenes_one_by_one(spark, tmp_path):
    """Of four scenes one is whole, one lacks a date, one has its dates apart, one has a class band without usable pixels; only the first is written, unless all are asked for."""
    px, m = synthetic_pair(spark)
    scenes = F.explode(F.expr("array(1L, 2L, 3L, 4L)")).alias("scene_id")
    px, m = px.drop("scene_id").select("*", scenes), m.drop("scene_id").select("*", scenes)
    px = px.where("not (scene_id = 2 and role = 'after')").select("scene_id", "role", "band", "row", "col", "dn")
    m = m.withColumn("c", F.expr("if(scene_id = 3 and role = 'after', c + 1e6, c)"))
    cells = px.where("band = 'B02' and scene_id = 4").select("scene_id", "role", "row", "col", F.lit(9).alias("scl"))
    cm = m.where("band = 'B02' and scene_id = 4").drop("band", "nodata")
    out = {r["scene_id"]: r for r in preprocess.preprocess(px, m, str(tmp_path / "a"), cells, cm).collect()}
    assert out[1]["passed"] and out[1]["problems"] == [] and out[1]["document"]["grid"]["width"] == 64
    assert {o["output"] for o in out[1]["document"]["outputs"]} == {"before", "after", "ndvi_difference", "scl_before", "scl_after"}
    assert out[2]["problems"] == ["after: bands_present"] and out[3]["problems"] == ["bounds: bounds_overlap", "bounds: overlap_covers_smaller_footprint"]
    assert out[4]["problems"] == ["after: scl_has_usable_pixels", "before: scl_has_usable_pixels"] and [out[k]["document"] for k in (2, 3, 4)] == [None] * 3
    assert sorted(p.name for p in (tmp_path / "a" / "before").glob("scene_id=*")) == ["scene_id=1"]
    forced = {r["scene_id"]: r for r in preprocess.preprocess(px, m, str(tmp_path / "b"), cells, cm, refuse=False).collect()}
    assert [k for k, r in sorted(forced.items()) if r["document"] is not None] == [1, 2, 4] and forced[4]["document"]["cloud_mask"]["masked_pixels"] == 64 * 64 and not forced[2]["passed"]
    assert preprocess.verdicts(preprocess.raw_checks(px, m.limit(0), cells)).count() == 0


def test_clouds_are_not_change(spark):
    px, m = synthetic_pair(spark)
    cells = spark.range(32 * 32).select(F.lit(1).cast("long").alias("scene_id"), F.floor(F.col("id") / 32).cast("int").alias("row"), (F.col("id") % 32).cast("int").alias("col"))
    both = cells.withColumn("role", F.explode(F.array(F.lit("before"), F.lit("after"))))
    cloud = (F.col("role") == "after") & F.col("row").between(10, 15) & F.col("col").between(10, 15)  # over the lost block
    classes = both.withColumn("scl", F.when(cloud, 9).otherwise(4))
    cm = spark.createDataFrame([(1, r, "EPSG:32643", 20.0, 0.0, 500000.0, 0.0, -20.0, 2000000.0, 32, 32) for r in ("before", "after")], "scene_id long, role string, crs string, a double, b double, c double, d double, e double, f double, width int, height int")
    out, _ = align.prepare_pairs(px, m, classes, cm)
    r = out.agg(F.count_if("change").alias("n"), F.count_if(~F.col("valid")).alias("masked")).first()
    assert r["masked"] == 144 and r["n"] == 0


@pytest.mark.parametrize("kernel", ["bilinear", "cubic", "cubic_spline", "lanczos", "average", "nearest"])
def test_constant_survives_every_kernel(spark, kernel):
    x = spark.range(100).select(F.lit(1).alias("k"), F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.when(F.col("id") != 44, 7.0).alias("dn"))
    g = lambda a, c, f, n: spark.createDataFrame([(1, a, c, -a, f, n, n)], "k int, a double, c double, e double, f double, width int, height int")
    out = resample.resample(x, g(10.0, 0.0, 0.0, 10), g(20.0, 5.0, -5.0, 4), ["k"], ["k"], kernel)
    got = [r["dn"] for r in out.collect()]
    assert len(got) == 16 and all(v is None or math.isclose(v, 7.0) for v in got) and sum(v is not None for v in got) >= 15


def test_splits(spark):
    rows = spark.range(150).selectExpr("id as k", "cast(id % 3 as int) as y")
    s = datasets.stratified_split(rows, "y", "k")
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"train": 90, "val": 30, "test": 30} and s.groupBy("split", "y").count().count() == 9
    with pytest.raises(ValueError):
        datasets.stratified_split(rows, "y", "k", 0.6, 0.5)
    with pytest.raises(ValueError):
        datasets.location_split(rows.where("y = 0"), "y")
    x = datasets.location_split(rows.selectExpr("k", "k % 10 as region"), "region").groupBy("region").agg(F.count_distinct("split").alias("n"))
    assert x.where("n > 1").count() == 0


def test_dataset_loading(spark, tmp_path):
    (tmp_path / "train.txt").write_text("# regions\nalpha, beta\n\n")
    (tmp_path / "test.txt").write_text("gamma\n")
    s = datasets.split_regions(readers.split_lines(spark, {"train": str(tmp_path / "train.txt"), "test": str(tmp_path / "test.txt")}))
    assert {(r["split"], r["region"]) for r in s.collect()} == {("train", "alpha"), ("train", "beta"), ("test", "gamma")} and datasets.leakage(s).count() == 0
    files = spark.createDataFrame([("alpha", "CM.PNG"), ("alpha", "alpha-cm.tif"), ("beta", "beta-cm.tif")], "region string, filename string")
    assert {r["region"]: r["filename"] for r in datasets.first_mask(files, [r"^cm\.png$", r"-cm\.tif$"]).collect()} == {"alpha": "CM.PNG", "beta": "beta-cm.tif"}
    px = spark.createDataFrame([("alpha", 0, 0), ("gamma", 0, 0)], "region string, row int, col int")
    masks = spark.createDataFrame([("alpha", 0, 0, 255)], "region string, row int, col int, value int")
    got = {r["region"]: (r["target"], r["annotated"]) for r in datasets.with_target(px, masks, ["region", "row", "col"]).collect()}
    assert got == {"alpha": (1, True), "gamma": (0, False)}
    rgb = datasets.rgb_as_bands(spark.createDataFrame([(1, 40, 90, 130)], "k int, red int, green int, blue int"), ["k"]).first()
    assert (rgb["b02"], rgb["b04"], rgb["b08"], rgb["channel_availability"]) == (130 / 255, 40 / 255, 0.0, [True, True, True, False])


def test_crop_and_flip(spark):
    x = spark.range(64 * 64).select(F.lit("a").alias("sample"), F.floor(F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"))
    sizes = spark.createDataFrame([("a", 64, 64), ("small", 8, 8)], "sample string, height int, width int")
    c = datasets.crop(x, sizes, 32)
    r = c.agg(F.count("*"), F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    assert tuple(r) == (1024, 0, 31, 0, 31)
    assert datasets.flip(c, 32).select("row", "col").distinct().count() == 1024


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        k = i % 3
        v = dict.fromkeys(FEATURE_NAMES, 0.0) | {"changed_area_ha": [0.3, 4, 14][k] + rng.random(), "veg_loss_ha_02": [0.1, 2.5, 11][k] + rng.random(), "large_patch_count": float([0, 1, 4][k]), "scl_veg_loss_ha": [0, 1, 4][k] + rng.random()}
        rows.append((f"s{i}", *(float(v[n]) for n in FEATURE_NAMES)))
    x = spark.createDataFrame(rows, "sample_id string, " + ", ".join(f"{n} double" for n in FEATURE_NAMES))
    return features.rule_label(x).cache()


def test_priority_model(spark, labelled, tmp_path):
    model = priority.fit(labelled, trees=20)
    s = priority.scored(labelled, model)
    m = priority.evaluate(s, probs="probs").first()
    assert m["accuracy"] > 0.95 and m["macro_f1"] > 0.9 and m["cohen_kappa"] > 0.9 and m["log_loss"] < 0.8
    sinks.model(model, str(tmp_path / "m"))
    again = priority.scored(labelled, readers.forest(str(tmp_path / "m")))
    assert s.select("sample_id", "predicted", "confidence").exceptAll(again.select("sample_id", "predicted", "confidence")).count() == 0
    a = explain.attributions(s, model, ["sample_id"])
    p = s.select("sample_id", F.array_max("probs").alias("p"))
    off = a.where("class_int = predicted_int").groupBy("sample_id").agg((F.sum("shap_value") + F.first("base")).alias("total")).join(p, "sample_id").agg(F.max(F.abs(F.col("total") - F.col("p")))).first()[0]
    assert off < 1e-6
    r = explain.assess(labelled, model, ["sample_id"]).where("predicted = 'HIGH'").first()
    assert r["action_insight"].startswith("HIGH: review now") and 1 <= len(r["top_drivers"]) <= 4 and r["top_drivers"][0]["direction"] == "increases"
    assert {r["priority_label"] for r in priority.class_counts(labelled).collect()} == {"LOW", "MEDIUM", "HIGH"}
    assert priority.importances(model).count() == 25


def test_attribution_by_brute_force():
    forest = [(np.array([0.2, 0.8]), [(0, -math.inf, 1.0, 0.3), (1, 2.0, math.inf, 0.6)]), (np.array([0.7, 0.3]), [(0, 1.0, math.inf, 0.7)])]
    x = np.array([[0.5, 3.0], [2.0, 1.0]])

    def value(row, known):
        return sum(s * math.prod((lo < row[f] <= hi) if f in known else z for f, lo, hi, z in path) for s, path in forest)

    phi, base = explain.attribute(x, forest)
    for i, row in enumerate(x):
        for f in range(2):
            g = 1 - f
            want = 0.5 * (value(row, {f}) - value(row, set())) + 0.5 * (value(row, {0, 1}) - value(row, {g}))
            assert np.allclose(phi[i, f], want)
        assert np.allclose(phi[i].sum(0) + base, value(row, {0, 1}))


def test_change_scorer(spark):
    px = block_pixels(spark, 40, 10, 20).withColumn("target", F.col("change").cast("int"))
    s = change.with_mask(change.score(px, change.fit_scorer(px)))
    assert change.confusion(s, []).first()["iou"] > 0.9
    by_hand = change.score_with(px, lambda b: (b["b_b08"] - b["a_b08"]).clip(0, 1), ["b_b08", "a_b08"])
    assert by_hand.where("change_prob > 0.2").count() == 121


def test_validation(spark):
    px, m = synthetic_pair(spark)
    assert validate.band_checks(px, ["scene_id", "role"]).where("not passed").count() == 0
    assert validate.meta_checks(m, ["scene_id", "role"]).where("not passed").count() == 0
    less = px.where("not (role = 'after' and band = 'B08')")
    assert [tuple(r) for r in validate.missing_bands(less, px.select("scene_id").distinct()).collect()] == [(1, "after", "B08")]
    report = validate.report(validate.band_checks(less, ["scene_id", "role"]), ["scene_id", "role"]).where("role = 'after'").first()
    assert not report["passed"] and "bands_present" in report["problems"]


def test_ledger(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    q = spark.sql("select * from values ('a', timestamp '2024-01-01 00:00:00'), ('b', timestamp '2024-01-02 00:00:00') t(analysis_id, created_at)").withColumn("parameters", F.struct(F.lit(0.5).alias("change_threshold")))
    ledger.create_runs(q, folder)
    summary = features.extract(block_pixels(spark)).drop("scene_id")
    x = q.select("analysis_id").join(summary).select(
        "analysis_id", F.when(F.col("analysis_id") == "a", "complete").otherwise("failed").alias("status"), F.lit("2024-01-03").cast("timestamp").alias("finished_at"), F.when(F.col("analysis_id") == "b", "bad").alias("error"),
        F.expr("named_struct('min_lon', 73.75D, 'min_lat', 18.45D, 'max_lon', 73.95D, 'max_lat', 18.6D)").alias("aoi"),
        F.expr("array(named_struct('role', 'before', 'item_id', 'S1', 'acquired', date '2023-12-15', 'cloud_cover_percent', 0.1D, 'crs', 'EPSG:32643'), named_struct('role', 'after', 'item_id', 'S2', 'acquired', date '2024-05-03', 'cloud_cover_percent', 0.2D, 'crs', 'EPSG:32643'))").alias("observations"),
        F.expr("named_struct('total_pixels', total_pixels, 'valid_pixels', valid_pixels, 'changed_pixels', changed_pixels, 'changed_area_ha', changed_area_ha, 'change_fraction', change_fraction_of_valid, 'threshold', 0.5D)").alias("change"),
        F.struct(*summary.columns).alias("summary"),
        F.expr("named_struct('priority', 'HIGH', 'confidence', 0.87D, 'probabilities', map('HIGH', 0.87D), 'label_provenance_notice', 'rule', 'drivers', array(named_struct('feature', 'veg_loss_ha_02', 'shap_value', 0.21D, 'feature_value', 4.0D), named_struct('feature', 'patch_count', 'shap_value', -0.14D, 'feature_value', 1.0D)))").alias("priority"),
        F.expr("named_struct('change_probability', '/x/p.tif', 'change_mask', '/x/m.tif', 'inference_summary', '/x/s.json', 'change_geojson', cast(null as string))").alias("artifacts"),
    )
    ledger.finish_runs(x, folder)
    tables = {n: ledger.read(spark, folder, n) for n in ledger.SCHEMAS}
    doc = {r["analysis_id"]: r for r in ledger.documents(tables).collect()}
    assert [f["position"] for f in doc["a"]["features"]] == list(range(20)) and len(doc["a"]["observations"]) == 2 and len(doc["a"]["artifacts"]) == 3
    assert [(d["rank"], d["direction"]) for d in doc["a"]["drivers"]] == [(1, "increases"), (2, "decreases")]
    assert doc["a"]["aoi"]["wkt"].startswith("POLYGON((73.75 18.45") and doc["b"]["status"] == "failed" and doc["b"]["aoi"] and not doc["b"]["features"]
    with pytest.raises(ValueError):
        ledger.finish_runs(x, folder)
    with pytest.raises(ValueError):
        ledger.finish_runs(x.withColumn("analysis_id", F.concat(F.lit("z"), "analysis_id")), folder)
    ledger.append(ledger.results_tables(x)["observations"], folder, "observations", "bcrashed")  # a finish that stopped half way
    assert ledger.read(spark, folder, "observations").count() == 2
    assert ledger.violations(tables).count() == 0
    assert ledger.history(ledger.latest(tables["runs"]), tables["priority_assessments"], tables["change_detections"]).count() == 2
    with pytest.raises(ValueError):
        ledger.page(tables["runs"], 0)


def test_sinks(spark, tmp_path):
    px = block_pixels(spark, 20, 5, 9)
    sinks.reflectance_stack(px, str(tmp_path / "stack"))
    sinks.ndvi_layer(px, str(tmp_path / "ndvi"))
    sinks.change_layers(change.with_mask(change.spectral_score(px)), str(tmp_path / "change"))
    assert spark.read.parquet(str(tmp_path / "stack")).where("B08 > 0").count() == 400
    assert sinks.file_records(spark, str(tmp_path / "ndvi")).where("path like '%.parquet'").select("bytes").first()[0] > 0
    x = features.rule_label(features.vector(features.extract(px), ["scene_id"])).withColumnRenamed("scene_id", "sample_id")
    sinks.features_csv(x, str(tmp_path / "csv"))
    r = readers.labelled_features(spark, str(tmp_path / "csv"), "expert").first()
    assert r["sample_id"] == "s" and r["changed_area_ha"] == 0.25 and r["priority_label"] in ("LOW", "MEDIUM", "HIGH")


def test_long_to_wide(spark):
    px, m = synthetic_pair(spark)
    w = pixels.from_long(px, m)
    assert w.count() == 64 * 64 and w.where("b_b08 is null").count() == 0
    assert stats.raw_band_stats(px, ["role", "band"]).count() == 8


def test_footprints(spark):
    """Ray casting at corners, edges and outside; a better scene that misses a corner is passed over."""
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]  # a notch from above
    points = {(0.0, 0.0): True, (2.0, 0.0): True, (2.0, 1.0): True, (2.0, 2.0): False, (1.0, 1.0): True, (3.0, 2.5): True, (0.5, 3.9): False, (4.0, 3.9): True, (4.1, 1.0): False, (-1.0, 0.0): False, (-1.0, 4.0): False, (2.0, 4.0): False, (5.0, 0.0): False}
    for closed in (ring, [*ring, ring[0]]):
        x = spark.createDataFrame([(px, py, closed) for px, py in points], "px double, py double, ring array<struct<x:double,y:double>>")
        assert {(r["px"], r["py"]): r["inside"] for r in x.select("px", "py", catalog.contains("ring", F.col("px"), F.col("py")).alias("inside")).collect()} == points
    box = (0.0, 0.0, 1.0, 1.0)
    square = lambda d: [(-1.0, -1.0), (2.0, -1.0), (2.0, d), (-1.0, 2.0)]
    rows = [("best", 1.0, "T1", square(0.4), box), ("second", 2.0, "T1", square(2.0), box), ("third", 0.0, "T2", square(2.0), box), ("none", 0.0, "T1", None, box)]
    s = spark.createDataFrame([(1, *r) for r in rows], "aoi int, item_id string, cloud_cover_percent double, tile string, footprint array<struct<x:double,y:double>>, aoi_box struct<minx:double,miny:double,maxx:double,maxy:double>")
    got = catalog.pick_containing(s, ["aoi"], F.lit("T1")).first()
    assert (got["item_id"], got["rank"]) == ("second", 3)
    assert catalog.pick_containing(s.where("item_id in ('best', 'none')"), ["aoi"], F.lit("T1")).count() == 0
    roles = s.withColumn("role", F.explode(F.array(F.lit("before"), F.lit("after"))))
    assert {r["item_id"] for r in catalog.pick_pair(roles, ["aoi"], F.lit("T1"), footprint="footprint").collect()} == {"second"}
