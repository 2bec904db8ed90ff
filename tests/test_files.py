"""Files of a scene are written by many tasks."""

from pyspark.sql import functions as F

from pixelweft.plans.oracles import SUMMARY
from pixelweft.sources import readers, sinks


def test_texts_a_file_each(spark, tmp_path):
    rows = spark.range(40).selectExpr("""format_string('{\\n  "id": %d,\\n  "role": "x"\\n}\\n', id) as value""").coalesce(1)
    sinks.texts(rows, str(tmp_path / "t"))
    files = [f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("part-")]
    assert len(files) == 40
    assert len({f.split("-")[1] for f in files}) > 1  # not all by one task
    found = readers.provenance(spark, str(tmp_path / "t"), "id long, role string").collect()
    assert sorted(r["id"] for r in found) == list(range(40)) and {r["role"] for r in found} == {"x"}


def test_layer_by_many_tasks(spark, tmp_path):
    px = spark.range(0, 4000, 1, 1).selectExpr("id div 100 as scene_id", "cast(id % 100 div 10 as int) as row", "cast(id % 10 as int) as col", "id as x")
    sinks.layer(px, str(tmp_path / "l"))
    files = [f.name for f in (tmp_path / "l").glob("scene_id=*/part-*.parquet")]
    assert len(files) == 40
    assert len({f.split("-")[1] for f in files}) > 1
    before = spark.conf.get(sinks._LISTING)
    assert sinks.file_records(spark, str(tmp_path / "l")).where("length(sha256) = 64 and bytes > 0").count() == 40
    assert spark.conf.get(sinks._LISTING) == before


def test_finish_reads_results_once(spark, tmp_path):
    """What makes results runs once, however many tables a finish writes; runs are dealt before they are sorted."""
    import datetime as dt

    from pixelweft.operators import analysis, ledger

    made = spark.sparkContext.accumulator(0)

    def seen(name):
        made.add(1)
        return name

    box = "named_struct('min_lon', 70D, 'min_lat', 18D, 'max_lon', 70.1D, 'max_lat', 18.1D) as aoi"
    nothing = spark.createDataFrame([], f"observations array<struct<{', '.join(f'{k} {t}' for k, t in analysis.OBSERVED.items())}>>, change struct<total_pixels long>, summary struct<{', '.join(f'{n} double' for n in SUMMARY if n != 'feature_vector_length')}>, priority {analysis.PRIORITY}, artifacts struct<change_probability string, change_mask string, inference_summary string, change_geojson string>").schema
    when = dt.datetime(2024, 6, 1)
    ids = spark.createDataFrame([(f"r{i}", when) for i in range(6)], "analysis_id string, created_at timestamp")
    folder = str(tmp_path / "ledger")
    ledger.create_runs(ids.selectExpr("analysis_id", "created_at", "named_struct('a', 1) as parameters"), folder)
    mark = F.udf(seen).asNondeterministic()
    results = ids.select(mark("analysis_id").alias("analysis_id"), F.lit("failed").alias("status"), F.lit(when).alias("finished_at"), F.lit(None).alias("error"), F.expr(box), *(F.lit(None).cast(f.dataType).alias(f.name) for f in nothing))
    ledger.finish_runs(results, folder)
    assert made.value == 6
    state = ledger.latest(ledger.read(spark, folder, "runs"))
    assert [(r["analysis_id"], r["status"]) for r in state.orderBy("analysis_id").collect()] == [(f"r{i}", "failed") for i in range(6)]
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.rindex("SortAggregate")  # no sort before the exchange


def test_region_pixels_are_read_once(spark):
    """Bands on the grid, bands that are brought onto it and masks come from one pass over the pixels."""
    from pixelweft.sources import labelled

    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    rows, grids = [], []
    for folder in ("imgs_1", "imgs_2"):
        for band, size in (("B02", 10.0), ("B03", 10.0), ("B04", 10.0), ("B08", 20.0)):
            m = int(40 / size)
            grids.append(("a", folder, f"{band}.tif", size, 0.0, -size, 0.0, m, m))
            rows += [("a", folder, f"{band}.tif", i, j, 1000.0) for i in range(m) for j in range(m)]
    rows += [("a", "cm", "cm.png", i, j, 255.0) for i in range(4) for j in range(4)]
    plain = spark.createDataFrame(rows, "region string, folder string, filename string, row int, col int, value double")
    g = spark.createDataFrame(grids, "region string, folder string, filename string, a double, c double, e double, f double, width int, height int")
    px = plain.withColumn("value", F.udf(seen, "double").asNondeterministic()("value"))
    got = labelled.load(plain.select("region", "folder", "filename").distinct(), px, g).collect()
    assert len(got) == 16 and {(r["before_b02"], r["after_b08"], r["target"], r["annotated"]) for r in got} == {(0.1, 0.1, 1, True)}
    assert read.value == len(rows)
