"""The feature row of each scene, the fixed vector of 25 and the rule label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweft.operators import patches, stats
from pixelweft.schemas import FEATURE_DESCRIPTIONS, FEATURE_NAMES


def extract(px: DataFrame, pixel_m2: float = 100.0) -> DataFrame:
    """All metrics of each scene: one aggregation over the pixels, and the patches of the change."""
    columns = [*stats.area_columns(pixel_m2), *stats.zone_columns(), *stats.vegetation_columns(pixel_m2), *stats.delta_columns(), *stats.transition_columns(pixel_m2)]
    rows = px.groupBy("scene_id").agg(*columns)
    found = patches.runs(px.where("change").select("scene_id", "row", "col"))
    sizes = patches.patch_stats(patches.patch_sizes(patches.label(found), pixel_m2), pixel_m2)
    x = rows.join(sizes.hint("merge"), "scene_id", "left")
    zero = {"patch_count": 0, "mean_patch_area_ha": 0.0, "max_patch_area_ha": 0.0, "large_patch_count": 0}
    x = x.fillna(zero).withColumn("patch_sizes_ha", F.coalesce("patch_sizes_ha", F.array().cast("array<double>")))
    # the unrounded area: density is not part of the rounding chain
    km2 = F.col("valid_pixels") * pixel_m2 / 1_000_000.0
    x = x.withColumn("valid_area_km2", km2)
    return x.withColumn("patch_density_per_km2", F.when(km2 > 0, F.round(F.col("patch_count") / F.when(km2 > 0, km2), 4)).otherwise(0.0))


def vector(features: DataFrame, keep: list[str]) -> DataFrame:
    """The 25 features in order, as doubles; NULL becomes 0."""
    return features.select(*keep, *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in FEATURE_NAMES))


# The weights and caps of the score, and below it the thresholds of the label.
def rule_score() -> Column:
    """0 to 100 from six capped terms."""
    c = F.col
    cap = lambda most, x: F.least(F.lit(float(most)), x)
    terms = (
        cap(25, c("veg_loss_ha_02") * 2.5) + cap(15, c("veg_loss_ha_03") * 5.0) + cap(25, c("scl_veg_loss_ha") * 5.0)
        + cap(12, c("large_patch_count") * 4.0) + cap(8, c("max_patch_area_ha") * 1.5)
        + cap(15, (c("change_fraction_of_valid") + c("veg_loss_fraction")) * 50.0)
    )
    # twice, so that a tie is a tie whatever the order of the sum
    return F.round(F.round(cap(100, terms), 9), 2)


def rule_label(vectors: DataFrame) -> DataFrame:
    """vectors with composite_score, hard_override, priority_label, priority_int and label_source."""
    c = F.col
    hard = (c("veg_loss_ha_02") >= 10.0) | (c("scl_veg_loss_ha") >= 5.0) | ((c("large_patch_count") >= 3) & (c("changed_area_ha") >= 8.0))
    medium = (c("composite_score") >= 22.0) | (c("veg_loss_ha_02") >= 2.0) | ((c("changed_area_ha") >= 3.0) & (c("large_patch_count") >= 1))
    name = F.when(hard | (c("composite_score") >= 55.0), "HIGH").when(medium, "MEDIUM").otherwise("LOW")
    x = vectors.withColumn("composite_score", rule_score()).withColumn("hard_override", F.when(hard, "critical_deforestation_scale")).withColumn("priority_label", name)
    return x.withColumn("priority_int", encode("priority_label")).withColumn("label_source", F.lit("rule_derived_prototype"))


def encode(name: str) -> Column:
    return F.when(F.col(name) == "LOW", 0).when(F.col(name) == "MEDIUM", 1).when(F.col(name) == "HIGH", 2)


def decode(code: str) -> Column:
    return F.when(F.col(code) == 0, "LOW").when(F.col(code) == 1, "MEDIUM").when(F.col(code) == 2, "HIGH")


def description(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.create_map(*(F.lit(x) for item in FEATURE_DESCRIPTIONS.items() for x in item))[name]


def summary_rows(features: DataFrame, keep: list[str]) -> DataFrame:
    """The twenty named values of a scene's summary as rows (keep, position, name, value)."""
    names = [
        "total_area_ha", "valid_area_ha", "total_area_km2", "valid_area_km2", "scl_veg_loss_ha", "feature_vector_length",
        "ndvi_before_mean", "ndvi_after_mean", "ndvi_diff_mean", "change_ndvi_diff_mean", "veg_loss_ha_01", "veg_loss_ha_02", "veg_loss_ha_03", "veg_gain_ha_02", "veg_loss_fraction",
        "patch_count", "mean_patch_area_ha", "max_patch_area_ha", "patch_density_per_km2", "large_patch_count",
    ]
    x = features.withColumn("feature_vector_length", F.lit(float(len(FEATURE_NAMES))))
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))
    return x.select(*keep, F.posexplode(pairs).alias("position", "p")).select(*keep, "position", "p.name", "p.value")
