"""Labelled data: splits, pairing, masks, crops and flips, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.functions import spectral as S
from pixelweft.operators.ranking import ranked


def seeded(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def stratified_split(rows: DataFrame, label: str, key: str, val: float = 0.2, test: float = 0.2, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Adds split: within each label, at least one row and round(fraction * n) rows for test and for val, the rest train."""
    if val <= 0 or test <= 0 or val + test >= 1:
        raise ValueError("fractions must be positive and sum to less than 1")
    order = seeded(key, seed) if order is None else order
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    x = ranked(rows, [label], [order, F.col(key)], "_r").join(counts.hint("merge"), label)
    share = lambda f: F.greatest(F.lit(1), F.round(F.col("_n") * f))
    x = x.withColumn("split", F.when(F.col("_r") <= share(test), "test").when(F.col("_r") <= share(test) + share(val), "val").otherwise("train"))
    return x.drop("_n", "_r")


def location_split(rows: DataFrame, region: str, val: float = 0.2, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Adds split: whole regions, at least one and round(fraction * n) of them, go to val."""
    regions = rows.select(region).distinct()
    n = regions.count()
    if n < 2:
        raise ValueError("at least two regions are needed")
    order = seeded(region, seed) if order is None else order
    chosen = regions.orderBy(order, region).limit(max(1, round(val * n))).withColumn("_val", F.lit(True))
    return rows.join(chosen.hint("merge"), region, "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def paired_names(names: DataFrame, parts: list[str], key: str = "stem", part: str = "part") -> tuple[DataFrame, DataFrame]:
    """The names that every part has, and the orphans: rows (name, part that has it)."""
    x = names.where(F.col(part).isin(parts)).select(key, part).distinct()
    full = x.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).select(key)
    return full, x.join(full.hint("merge"), key, "left_anti")


def split_regions(lines: DataFrame) -> DataFrame:
    """Rows (split, region) from rows (split, value) of comma- or line-separated text; comments and blanks go."""
    x = lines.select("split", F.explode(F.split(F.regexp_replace("value", "#.*$", ""), ",")).alias("region"))
    return x.select("split", F.trim("region").alias("region")).where("region != ''").distinct()


def leakage(splits: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    """Regions in both splits; there must be none."""
    of = lambda s: splits.where(F.col("split") == s).select("region")
    return of(a).intersect(of(b))


def unresolved(splits: DataFrame, present: DataFrame) -> DataFrame:
    """Regions that a split names and no data has."""
    return splits.select("region").distinct().join(present.select("region").distinct().hint("merge"), "region", "left_anti")


def first_mask(files: DataFrame, patterns: list[str]) -> DataFrame:
    """For each region the mask file that matches the earliest pattern (file names in any case); none, no row."""
    name = F.lower("filename")
    place = F.coalesce(*(F.when(name.rlike(p), i) for i, p in enumerate(patterns)))
    w = Window.partitionBy("region").orderBy("_place", "filename")
    x = files.withColumn("_place", place).where("_place is not null").withColumn("_r", F.row_number().over(w))
    return x.where("_r = 1").drop("_place", "_r")


def with_target(pixels: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """target and annotated: a region without a mask has target 0 everywhere, and is told apart."""
    have = masks.select("region").distinct().withColumn("annotated", F.lit(True))
    x = pixels.join(masks.select(*keys, S.annotation("value").alias("target")).hint("merge"), keys, "left").join(have.hint("merge"), "region", "left")
    return x.withColumn("target", F.coalesce("target", F.lit(0))).withColumn("annotated", F.coalesce("annotated", F.lit(False)))


def rgb_as_bands(rgb: DataFrame, keys: list[str], nir: bool = True) -> DataFrame:
    """Red, green and blue to b04, b03 and b02; near infrared is 0 and told to be absent."""
    cols = [S.eight_bit("blue").alias("b02"), S.eight_bit("green").alias("b03"), S.eight_bit("red").alias("b04")]
    flags = [True, True, True]
    if nir:
        cols, flags = [*cols, F.lit(0.0).alias("b08")], [*flags, False]
    return rgb.select(*keys, *cols, F.lit(flags).alias("channel_availability"))


def crop(pixels: DataFrame, sizes: DataFrame, patch: int, seed: int = 42, key: str = "sample", offsets: tuple[Column, Column] | None = None) -> DataFrame:
    """A patch of each sample at an offset that seed and sample give, or at ``offsets`` (row and column, of the sizes); samples smaller than the patch go."""
    s = sizes.where((F.col("height") >= patch) & (F.col("width") >= patch))
    at = lambda salt, size: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)), F.col(size) - patch + 1)
    r0, c0 = offsets or (at("r", "height"), at("c", "width"))
    s = s.select(key, r0.alias("_r0"), c0.alias("_c0"))
    x = pixels.join(s.hint("merge"), key).where(F.col("row").between(F.col("_r0"), F.col("_r0") + patch - 1) & F.col("col").between(F.col("_c0"), F.col("_c0") + patch - 1))
    return x.withColumn("row", (F.col("row") - F.col("_r0")).cast("int")).withColumn("col", (F.col("col") - F.col("_c0")).cast("int")).drop("_r0", "_c0")


def flip(pixels: DataFrame, patch: int, seed: int = 42, key: str = "sample", flips: tuple[Column, Column] | None = None) -> DataFrame:
    """Horizontal and vertical flips, each for about half of the samples, as seed and sample give; or where ``flips`` (horizontal, vertical) say so."""
    bit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(key)), F.lit(2)) == 1
    back = lambda c, b: F.when(b, patch - 1 - F.col(c)).otherwise(F.col(c)).cast("int")
    h, v = flips or (bit("h"), bit("v"))
    return pixels.withColumns({"col": back("col", h), "row": back("row", v)})


def concatenated(primary: DataFrame, secondary: DataFrame, names: tuple[str, str] = ("primary", "secondary")) -> DataFrame:
    """Both datasets, told apart by a column; the primary first where order is asked for."""
    return primary.withColumn("dataset", F.lit(names[0])).unionByName(secondary.withColumn("dataset", F.lit(names[1])), allowMissingColumns=True)


def change_fractions(pixels: DataFrame, by: list[str]) -> DataFrame:
    return pixels.groupBy(*by).agg(F.round(F.avg("target"), 6).alias("change_fraction"))


def summary(fractions: DataFrame, by: list[str]) -> DataFrame:
    x = F.col("change_fraction")
    return fractions.groupBy(*by).agg(F.count("*").alias("samples"), F.round(F.min(x), 6).alias("min_fraction"), F.round(F.avg(x), 6).alias("mean_fraction"), F.round(F.max(x), 6).alias("max_fraction"))


def sample_problems(samples: DataFrame, key: str = "sample") -> DataFrame:
    """Per sample: both dates and the mask cover the same cells, values are finite and within [0, 1].

    A date covers a cell if all its bands do; the mask, if it has a target. A sample's cells are the rows that it has, one for each cell of either date."""
    from pixelweft.operators.change import INPUTS
    from pixelweft.operators.validate import stacked

    there = lambda r: S.all_present(*(c for c in INPUTS if c.startswith(f"{r}_")))
    inside = F.lit(True)
    for c in INPUTS:
        inside = inside & F.coalesce(F.col(c).between(0, 1), F.lit(True))
    per = {"same_shape": F.bool_and(there("b") == there("a")), "mask_matches": F.bool_and(F.col("target").isNotNull() == (there("b") | there("a"))), "in_range": F.bool_and(inside)}
    return stacked(samples.groupBy(key).agg(*(c.alias(n) for n, c in per.items())), [key], {n: F.col(n) for n in per})


def best_epoch(history: DataFrame, metric: str, by: list[str] | None = None) -> DataFrame:
    """The row of the best epoch by a metric; of ties the earlier. Rows without the metric are an error."""
    if metric not in history.columns:
        raise ValueError(f"the history has no {metric}")
    row = F.struct(*history.columns)
    best = F.max_by(row, F.struct(F.col(metric), -F.col("epoch"))).alias("b")
    g = history.groupBy(*by).agg(best) if by else history.agg(best)
    return g.where("b is not null").select("b.*")
