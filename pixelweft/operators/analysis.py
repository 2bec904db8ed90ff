"""From a table of requests to a table of results, many areas at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.operators import change, datasets, evaluation, explain, features, grid, ledger, stats, validate
from pixelweft.storage import durable

Scorer = Callable[[DataFrame], DataFrame]


def clip(px: DataFrame, grids: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside each scene's box (scene_id, minx..maxy, in the grid's units). Scenes without a box go."""
    w = grid.pixel_window(grids.join(boxes, "scene_id")).select("scene_id", "row0", "row1", "col0", "col1")
    x = px.join(w, "scene_id").where((F.col("row") >= F.col("row0")) & (F.col("row") < F.col("row1")) & (F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col1")))
    return x.drop("row0", "row1", "col0", "col1")


def infer(px: DataFrame, scorer: Scorer = change.spectral_score, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Scored pixels with their change mask, and the statistics of each scene."""
    scored = change.with_mask(scorer(px), threshold)
    return scored, stats.inference_stats(scored, ["scene_id"])


def train(px: DataFrame, region: str = "scene_id", grid_: list[dict] | None = None, metric: str = "iou", val: float = 0.2, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """The best of several scorers by a metric on whole regions kept apart, and the history of all.

    The validation pixels are read once: all scorers are columns of one pass."""
    rows = datasets.location_split(px, region, val, seed)
    settings = grid_ or [{"reg": 0.1}, {"reg": 0.01}, {"reg": 0.001}]
    fitted = change.fit_scorers(rows.where("split = 'train'"), settings)
    held, _ = change.pixel_inputs(rows.where("split = 'val'"))
    found = evaluation.compared(held, {str(i): change.linear_score(m) for i, m in enumerate(fitted)})
    history = durable(found.withColumn("epoch", F.col("setting").cast("int")).drop("setting"), "history")  # a row for each setting
    best = datasets.best_epoch(history, metric).first()
    return fitted[best["epoch"]], history


#: Artifacts of a complete run: name and file.
ARTIFACTS = {"change_probability": "change_probability.tif", "change_mask": "change_mask.tif", "inference_summary": "inference_summary.json"}
OBSERVED = {"role": "string", "item_id": "string", "acquired": "date", "cloud_cover_percent": "double", "crs": "string"}
PRIORITY = "struct<priority string, confidence double, probabilities map<string,double>, label_provenance_notice string, action_insight string, drivers array<struct<rank int, feature string, feature_value double, shap_value double, direction string, description string>>>"


def analyse(requests: DataFrame, scenes: DataFrame, px: DataFrame, model: PipelineModel | None = None, scorer: Scorer = change.spectral_score, finished_at=None, root: str = "/artifacts") -> DataFrame:
    """One result for each request, as ``ledger.finish_runs`` takes it: analysis_id, status, error, finished_at, aoi, observations, change, summary, priority, artifacts.

    Requests don't touch each other: one that is refused fails with its problems, one whose scenes aren't both there has no data, one whose pixels fail a check fails with the checks' names; the
    others are complete. Only complete ones have results. ``scenes``: rows (analysis_id, role, and item_id, acquired, cloud_cover_percent, crs where known) of what the catalogue gave; ``px``: pair pixels whose scene_id is
    the analysis_id. Each request's own threshold decides its change mask. Without a model there is no priority, and the rest stands. Requests without an id can't be told apart and are left out.
    ``finished_at``: a timestamp, else now.
    """
    asked = validate.request_problems(requests).where("analysis_id is not null")
    ok = asked.where("accepted")
    own = px.join(ok.select(F.col("analysis_id").alias("scene_id"), "change_threshold").hint("merge"), "scene_id")
    scored = scorer(own)
    changed = F.col("valid") & F.coalesce(F.col("change_prob") > F.col("change_threshold"), F.lit(False))
    rows = features.extract(scored.withColumn("change", changed))
    checks = validate.processed_checks(scored).where(~F.col("check").isin("mostly_valid", "usable_in_both")).withColumnRenamed("scene_id", "analysis_id")
    state = ledger.run_states(asked, scenes, checks)
    refused = ~F.col("accepted")
    state = state.withColumns({
        "error": F.when(refused, F.concat(F.lit("refused: "), F.array_join("problems", "; "))).when(F.col("status") == "no_data", F.lit("observations are missing")).otherwise(F.col("error")),
        "status": F.when(refused, "failed").otherwise(F.col("status")),
    })
    seen = scenes.select("analysis_id", F.struct(*((F.col(c) if c in scenes.columns else F.lit(None)).cast(t).alias(c) for c, t in OBSERVED.items())).alias("o"))
    seen = seen.groupBy("analysis_id").agg(F.sort_array(F.collect_list("o"), asc=False).alias("observations"))  # before comes first
    summary = rows.select(F.col("scene_id").alias("analysis_id"), F.struct("total_pixels", "valid_pixels", "changed_pixels", "changed_area_ha", F.col("change_fraction_of_valid").alias("change_fraction")).alias("c"), F.struct(*(c for c in rows.columns if c != "scene_id")).alias("summary"))
    out = state.join(summary.hint("merge"), "analysis_id", "left").join(seen.hint("merge"), "analysis_id", "left")
    found = F.lit(None).cast(PRIORITY)
    if model is not None:
        x = explain.assess(features.vector(rows, ["scene_id"]), model, ["scene_id"])
        found = F.struct(F.col("predicted").alias("priority"), "confidence", "probabilities", "label_provenance_notice", "action_insight", F.col("top_drivers").alias("drivers")).cast(PRIORITY)
        x = x.select(F.col("scene_id").alias("analysis_id"), found.alias("p"))
        out, found = out.join(x.hint("merge"), "analysis_id", "left"), F.col("p")
    done = F.col("status") == "complete"
    files = F.struct(*(F.concat(F.lit(f"{root}/"), F.col("analysis_id"), F.lit(f"/{f}")).alias(n) for n, f in ARTIFACTS.items()), F.lit(None).cast("string").alias("change_geojson"))
    when = F.current_timestamp() if finished_at is None else F.lit(finished_at)
    return out.select(
        "analysis_id", "status", "error", when.alias("finished_at"), F.struct("min_lon", "min_lat", "max_lon", "max_lat").alias("aoi"), F.when(done, F.col("observations")).alias("observations"),
        F.when(done, F.struct("c.*", F.col("change_threshold").alias("threshold"))).alias("change"), F.when(done, F.col("summary")).alias("summary"), F.when(done, found).alias("priority"), F.when(done, files).alias("artifacts"),
    )
