"""The ledger of runs: eight append-only Parquet tables in a folder, a log of what is finished, and the queries on them.

A finish writes its rows as a batch, and then one entry of the log. Entries are numbered and each number can be taken once: of two finishes that run at the same
time one takes it, and the other looks again at what is finished before it tries the next. Rows count once the log has their batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.functions import spectral as S
from pixelweft.operators import features
from pixelweft.operators.validate import stacked
from pixelweft.storage import durable, scratch

SCHEMAS = {
    "runs": "analysis_id string, created_at timestamp, status string, parameters string, started_at timestamp, finished_at timestamp, error string",
    "aois": "analysis_id string, min_lon double, min_lat double, max_lon double, max_lat double, area_km2 double, wkt string",
    "observations": "analysis_id string, role string, item_id string, acquired date, cloud_cover_percent double, crs string",
    "change_detections": "analysis_id string, total_pixels long, valid_pixels long, changed_pixels long, changed_area_ha double, change_fraction double, threshold double, change_polygons_available boolean",
    "environmental_features": "analysis_id string, position int, name string, value double",
    "priority_assessments": "analysis_id string, priority string, confidence double, probabilities map<string,double>, label_provenance_notice string",
    "shap_drivers": "analysis_id string, rank int, feature string, shap_value double, feature_value double, direction string, description string",
    "artifacts": "analysis_id string, artifact_type string, filename string, relative_path string, url string",
}
RESULT = ("analysis_id", "status", "finished_at", "error", "aoi", "observations", "change", "summary", "priority", "artifacts")
#: Entries of the log that are named in a filter on folders; a longer log is joined.
ENTRIES = 10_000
STATUSES, DIRECTIONS = ("pending", "running", "complete", "failed", "no_data"), ("increases", "decreases")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, and no Python workers to find that out."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with the batch that each row came in; one that was never written is empty."""
    from pyspark.errors import AnalysisException

    schema = SCHEMAS[name] + ", batch string"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return _empty(spark, schema)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (batch, version) of the log."""
    from pyspark.errors import AnalysisException

    try:
        x = spark.read.text(f"{folder}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return _empty(spark, "batch string, version long")
    return x.select(F.col("value").alias("batch"), F.regexp_extract(F.col("_metadata.file_name"), "^v([0-9]+)$", 1).cast("long").alias("version"))


def _take(spark: SparkSession, folder: str, version: int, batch: str) -> bool:
    """Write entry ``version`` of the log, whole or not at all; False if it is taken. On a file system whose renames are not atomic and exclusive (some object stores), use one writer."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    draft, entry = path(f"{folder}/drafts/{batch}"), path(f"{folder}/log/v{version}")
    fs.mkdirs(path(f"{folder}/log"))
    out = fs.create(draft, True)
    out.write(bytearray(f"{batch}\n".encode()))
    out.close()
    if fs.getScheme() != "file":
        return not fs.exists(entry) and fs.rename(draft, entry)
    # a local rename replaces what is there; a link doesn't
    files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
    try:
        files.createLink(paths.get(fs.makeQualified(entry).toUri()), paths.get(fs.makeQualified(draft).toUri()))
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
    return True


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A ledger table. Rows of a finish count once the log has it: what a crashed finish left behind, or one that lost to another, is never seen."""
    x = _stored(spark, folder, name)
    log = _log(spark, folder).select("batch")
    created = F.col("batch").startswith("created") if name == "runs" else F.lit(False)
    entries = [r["batch"] for r in log.limit(ENTRIES + 1).collect()]
    if len(entries) <= ENTRIES:
        # a batch may be a whole table, and in a join its rows would meet in one task: so the log picks folders
        return x.where(F.col("batch").isin(entries) | created).drop("batch")
    return x.join(log.hint("merge"), "batch", "left_semi").unionByName(x.where(created)).drop("batch")


def append(rows: DataFrame, folder: str, name: str, batch: str) -> None:
    """Each batch is a folder of its own, so that writers at the same time don't meet."""
    rows.to(rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema).write.mode("append").parquet(f"{folder}/{name}/batch={batch}")


def latest(runs: DataFrame) -> DataFrame:
    """The last state of each run: a finished one over a running one.

    Strings are picked by sorting, so rows are dealt by run first: a task sorts its share of the runs, not all that it read. Nearly all rows are of different runs.
    """
    runs = runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "analysis_id")
    order = F.struct(F.col("finished_at").isNotNull().cast("int"), F.coalesce("finished_at", "created_at"))
    return runs.groupBy("analysis_id").agg(F.max_by(F.struct(*(c for c in runs.columns if c != "analysis_id")), order).alias("r")).select("analysis_id", "r.*")


def create_runs(requests: DataFrame, folder: str) -> None:
    """A running row for each request (analysis_id, created_at, parameters struct)."""
    rows = requests.select("analysis_id", "created_at", F.lit("running").alias("status"), F.to_json("parameters").alias("parameters"), F.col("created_at").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("error"))
    append(rows, folder, "runs", f"created{uuid.uuid4().hex}")


def results_tables(results: DataFrame) -> dict[str, DataFrame]:
    """The rows of seven tables from nested results. Failed runs have their run and area only."""
    done = results.where("status = 'complete'")
    a = F.col("aoi")
    box = [a[k] for k in ("min_lon", "min_lat", "max_lon", "max_lat")]
    order = F.struct
    arts = F.array(*(order(F.lit(k).alias("artifact_type"), F.col(f"artifacts.{k}").alias("url")) for k in ("change_probability", "change_mask", "inference_summary", "change_geojson")))
    art = done.select("analysis_id", F.explode(arts).alias("p")).select("analysis_id", "p.*").where("url is not null").withColumn("filename", F.substring_index("url", "/", -1))
    name = lambda k: F.col(f"p.{k}")
    return {
        "aois": results.select("analysis_id", "aoi.*", S.bbox_area_km2(*box).alias("area_km2"), S.bbox_wkt(*box).alias("wkt")),
        "observations": done.select("analysis_id", F.explode("observations").alias("p")).select("analysis_id", "p.*"),
        "change_detections": done.where("change is not null").select("analysis_id", "change.*", F.lit(False).alias("change_polygons_available")),
        "environmental_features": features.summary_rows(done.where("summary is not null").select("analysis_id", "summary.*"), ["analysis_id"]),
        "priority_assessments": done.where("priority is not null").select("analysis_id", *(F.col(f"priority.{k}") for k in ("priority", "confidence", "probabilities", "label_provenance_notice"))),
        "shap_drivers": done.where("priority is not null").select("analysis_id", F.posexplode("priority.drivers").alias("i", "p")).select(
            "analysis_id", (F.col("i") + 1).alias("rank"), name("feature"), name("shap_value"), name("feature_value"), F.when(name("shap_value") >= 0, "increases").otherwise("decreases").alias("direction"), features.description(name("feature")).alias("description")),
        "artifacts": art.select("analysis_id", "artifact_type", "filename", F.concat_ws("/", "analysis_id", "filename").alias("relative_path"), "url"),
    }


def _refuse(results: DataFrame, folder: str) -> DataFrame:
    """The state of all runs; raises if one of ``results`` is unknown, finished or given twice."""
    state = latest(read(results.sparkSession, folder, "runs"))
    x = results.select("analysis_id").join(state.select("analysis_id", F.col("status").alias("s")).hint("merge"), "analysis_id", "left")
    bad = x.agg(F.count_if(F.col("s").isNull()).alias("unknown"), F.count_if(F.col("s").isNotNull() & (F.col("s") != "running")).alias("finished"), (F.count(F.lit(1)) - F.count_distinct("analysis_id")).alias("twice")).first()
    if bad["unknown"] or bad["finished"] or bad["twice"]:
        raise ValueError(f"unknown runs: {bad['unknown']}, finished already: {bad['finished']}, given twice: {bad['twice']}")
    return state


def finish_runs(results: DataFrame, folder: str) -> None:
    """Finish runs once: an unknown run, or one that is finished, is an error and nothing of the call counts. That holds for calls that run at the same time too: the first to enter the log has its runs.

    ``results``: analysis_id, status, finished_at, error, aoi, observations, change, summary, priority, artifacts.
    """
    spark = results.sparkSession
    with scratch():
        # results may be a long way from their tables, and nine jobs read them
        results = durable(results.select(*RESULT).withColumn("error", F.col("error").cast("string")), "results")
        state = _refuse(results, folder)
        seen = _log(spark, folder).agg(F.max("version")).first()[0] or 0
        batch = f"b{uuid.uuid4().hex}"
        for name, rows in results_tables(results).items():
            append(rows, folder, name, batch)
        rows = results.select("analysis_id", "status", "finished_at", "error").join(state.drop("status", "finished_at", "error").hint("merge"), "analysis_id")
        append(rows, folder, "runs", batch)
        while not _take(spark, folder, seen + 1, batch):
            seen += 1
            _refuse(results, folder)  # another finish came first: it may have had one of these runs


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (analysis_id, check, passed = false) that break a domain: status, role, direction."""
    per = {"runs": ("status", STATUSES), "observations": ("role", ("before", "after")), "shap_drivers": ("direction", DIRECTIONS)}
    out = None
    for name, (column, allowed) in per.items():
        if name in tables:
            x = stacked(tables[name], ["analysis_id"], {f"{name}.{column}": F.col(column).isin(list(allowed))}).where(~F.col("passed"))
            out = x if out is None else out.unionByName(x)
    return out


def history(runs: DataFrame, priorities: DataFrame, changes: DataFrame) -> DataFrame:
    """Each run with its priority and changed area, where it has them."""
    x = runs.select("analysis_id", "created_at", "status").join(priorities.select("analysis_id", "priority", "confidence").hint("merge"), "analysis_id", "left")
    return x.join(changes.select("analysis_id", "changed_area_ha").hint("merge"), "analysis_id", "left")


def page(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a history, newest first."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must lie in 1..100 and offset must not be negative")
    return rows.orderBy(F.desc("created_at"), F.desc("analysis_id")).offset(offset).limit(limit)


def total(rows: DataFrame) -> DataFrame:
    """How many rows a history has, whatever the page."""
    return rows.agg(F.count("*").alias("total"))


def documents(tables: dict[str, DataFrame]) -> DataFrame:
    """One nested row for each run: 1:N tables become ordered arrays before the join."""
    x = latest(tables["runs"])
    one = {"aois": "aoi", "change_detections": "change", "priority_assessments": "priority"}
    many: dict[str, tuple[str, list[Column]]] = {"observations": ("observations", [F.desc("role")]), "environmental_features": ("features", []), "shap_drivers": ("drivers", []), "artifacts": ("artifacts", [])}
    for name, alias in one.items():
        t = tables[name]
        x = x.join(t.select("analysis_id", F.struct(*(c for c in t.columns if c != "analysis_id")).alias(alias)).hint("merge"), "analysis_id", "left")
    for name, (alias, _) in many.items():
        t = tables[name]
        rows = t.groupBy("analysis_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in t.columns if c != "analysis_id")))).alias(alias))
        x = x.join(rows.hint("merge"), "analysis_id", "left")
    return x


def run_states(requests: DataFrame, scenes: DataFrame, checks: DataFrame) -> DataFrame:
    """Requests with a status: no_data without both scenes, failed where a check failed, else complete.

    ``scenes``: rows (analysis_id, role); ``checks``: rows (analysis_id, check, passed).
    """
    have = scenes.groupBy("analysis_id").agg(F.count_distinct("role").alias("_roles"))
    ok = checks.groupBy("analysis_id").agg(F.bool_and("passed").alias("_ok"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ", ").alias("_bad"))
    x = requests.join(have.hint("merge"), "analysis_id", "left").join(ok.hint("merge"), "analysis_id", "left")
    status = F.when(F.coalesce("_roles", F.lit(0)) < 2, "no_data").when(~F.coalesce("_ok", F.lit(True)), "failed").otherwise("complete")
    return x.withColumn("status", status).withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("failed checks: "), F.col("_bad")))).drop("_roles", "_ok", "_bad")
