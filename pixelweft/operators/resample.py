"""Resampling: source pixels add to the target cells under their kernel; across reference systems target cells meet the pixels in one equi-join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.operators import grid
from pixelweft.storage import durable, small_batches

GRID = ("a", "c", "e", "f", "width", "height")


def _cubic(a: float) -> Callable[[Column], Column]:
    def w(t: Column) -> Column:
        t = F.abs(t)
        near = (a + 2) * t * t * t - (a + 3) * t * t + 1
        far = a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a
        return F.when(t <= 1, near).when(t < 2, far).otherwise(0.0)

    return w


def _spline(t: Column) -> Column:
    t = F.abs(t)
    return F.when(t <= 1, 2.0 / 3 - t * t + t * t * t / 2).when(t < 2, (2 - t) * (2 - t) * (2 - t) / 6).otherwise(0.0)


def _sinc(t: Column) -> Column:
    import math

    return F.when(t == 0, 1.0).otherwise(F.sin(math.pi * t) / (math.pi * t))


def _lanczos(t: Column) -> Column:
    return F.when(F.abs(t) < 3, _sinc(t) * _sinc(t / 3)).otherwise(0.0)


#: Kernel: half width in source pixels, weight of a distance.
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "bilinear": (1, lambda t: F.greatest(F.lit(0.0), 1 - F.abs(t))),
    "cubic": (2, _cubic(-0.5)),
    "cubic_spline": (2, _spline),
    "lanczos": (3, _lanczos),
}


def _rasters(source: DataFrame, target: DataFrame, keys: list[str], target_keys: list[str]) -> DataFrame:
    """One row for each raster: keys, its grid as s_a.., and the target's grid. ``crs`` is there if both sides have it."""
    grid_ = (*GRID, "crs") if "crs" in source.columns and "crs" in target.columns else GRID
    src = source.select(*keys, *(F.col(c).alias(f"s_{c}") for c in grid_))
    return src.join(target.select(*target_keys, *grid_).hint("merge"), target_keys)


def _rows(rasters: DataFrame) -> DataFrame:
    return rasters.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))


def _cells(rasters: DataFrame) -> DataFrame:
    return _rows(rasters).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))


#: Cells whose places a task works out at a time, and the farthest row or column of a pixel: beyond it a cell's place isn't known.
CELLS, FAR = 1 << 17, 2.0**30


def _placed(batch: pa.RecordBatch, keys: list[str], sized: bool) -> Iterator[pa.RecordBatch]:
    """Rows (keys, row, col, fc, fr, and zc, zr if ``sized``) of the cells of a batch of raster rows."""
    x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in keys}
    ends = np.cumsum(x["width"], dtype=np.int64)
    for i in range(0, int(ends[-1]), CELLS):
        cell = np.arange(i, min(i + CELLS, int(ends[-1])))
        at = np.searchsorted(ends, cell, side="right")
        col = cell - (ends[at] - x["width"][at])
        y = {c: v[at] for c, v in x.items()}
        systems = [tuple(y[f"{p}{c}"] for c in ("lonlat", "zone", "north")) for p in ("", "s_")]
        px, py = y["c"] + y["a"] * (col + 0.5), y["f"] + y["e"] * (y["row"] + 0.5)
        there = grid.projected_arrays(px, py, *systems)
        fc, fr = (there[0] - y["s_c"]) / y["s_a"] - 0.5, (there[1] - y["s_f"]) / y["s_e"] - 0.5
        known = (np.abs(fc) < FAR) & (np.abs(fr) < FAR)
        out = [pa.array(f, mask=~known) for f in (fc, fr)]
        if sized:
            half = grid.projected_arrays(px + y["a"] / 2, py + y["e"] / 2, *systems)
            out += [pa.array(np.fmax(1.0, np.abs(2 * (h - t) / s))) for h, t, s in ((half[0], there[0], y["s_a"]), (half[1], there[1], y["s_e"]))]
        owner = pa.array(at)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in keys), pa.array(y["row"].astype(np.int32)), pa.array(col.astype(np.int32)), *out], [*keys, "row", "col", "fc", "fr", *(["zc", "zr"] if sized else [])])


def _places(rasters: DataFrame, keys: list[str], sized: bool = True) -> DataFrame:
    """Rows (keys, row, col, fc, fr, zc, zr) for each cell of each target grid in another system: where its centre lies among the source's pixels, and how many of these a cell is wide and high.

    The centre is brought into the source's system, and with it the points half a cell around it, which give the size (if ``sized``).
    A table of rasters is small, and Spark would read it in one task: the rows of all rasters are dealt out before they become cells.
    """
    small_batches(rasters.sparkSession)
    n = int(rasters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = [F.col(c).cast("double").alias(c) for g in ("a", "c", "e", "f") for c in (g, f"s_{g}")]
    systems = [v.alias(k) for p in ("", "s_") for k, v in grid.system(f"{p}crs", p).items()]
    rows = _rows(rasters.where("width > 0 and height > 0")).select(*keys, "row", "width", *numbers, *systems).repartition(n, *keys, "row")
    names = ["fc", "fr", *(["zc", "zr"] if sized else [])]
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("row", "col")] + [T.StructField(c, T.DoubleType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _placed(batch, keys, sized)

    return rows.mapInArrow(run, schema)


def resample(pixels: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], target_keys: list[str], kernel: str = "bilinear", value: str = "dn") -> DataFrame:
    """Rows (keys, row, col, value) on the target grids: every cell, NULL where no valid source pixel counts.

    ``pixels`` has (keys, row, col, value), NULL for invalid; ``source`` and ``target`` hold one grid for
    each keys and target_keys (a subset of keys). Weights are renormalised over the valid pixels; a cell
    is valid where its nearest source pixel is. Kernels widen when the target is coarser. 'average'
    takes the mean of the source pixels whose centres lie in the cell. Grids with a column ``crs`` may be in different reference systems (lon/lat and UTM).

    Within one system a pixel works out the cells that it counts for, and the sums of a task are all that moves (``_scattered``).
    Rasters in another system have their cells look up the pixels (``_gathered``).
    """
    rasters = _rasters(source, target, keys, target_keys)
    if "crs" not in rasters.columns:
        return _scattered(pixels, rasters, keys, kernel, value)
    rasters = durable(rasters, "rasters")
    same = F.col("crs").eqNullSafe(F.col("s_crs"))
    if rasters.where(~same).isEmpty():
        return _scattered(pixels, rasters, keys, kernel, value)
    apart = _gathered(pixels, rasters.where(~same), keys, kernel, value)
    if rasters.where(same).isEmpty():
        return apart
    return apart.unionByName(_scattered(pixels, rasters.where(same), keys, kernel, value))


#: By how much of a pixel the cells of a pixel are sought more widely than the kernel reaches; the weights decide. Pairs of a pixel and a cell that a task holds at a time.
SLACK, PAIRS = 1e-3, 1 << 20


def _spread_cubic(t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0.0))


def _spread_spline(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, 2 / 3 - t**2 + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


#: The weights of ``KERNELS`` for arrays of distances.
SPREAD: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "bilinear": lambda t: np.maximum(0.0, 1 - np.abs(t)), "cubic": _spread_cubic, "cubic_spline": _spread_spline,
    "lanczos": lambda t: np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0),
}


def _along(at: np.ndarray, step: np.ndarray, s_step: np.ndarray, first: np.ndarray, s_first: np.ndarray, n: np.ndarray, kernel: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pixels ``at`` along one axis the cells that they may count for, one column each, with weight and whether the pixel is the cell's nearest. Cells outside the grid have neither."""
    at, step, s_step, first, s_first, n = (x[:, None] for x in (at, step, s_step, first, s_first, n))
    share, start = step / s_step, (first + step * 0.5 - s_first) / s_step - 0.5
    z = np.maximum(1.0, share)
    reach = (KERNELS[kernel][0] if kernel in KERNELS else 0.5) * z + SLACK
    ends = (at - reach - start) / share, (at + reach - start) / share
    low, high = np.ceil(np.minimum(*ends)).astype(np.int64), np.floor(np.maximum(*ends)).astype(np.int64)
    low, high = np.maximum(low, 0), np.minimum(high, n - 1)
    cell = low + np.arange(max(0, int((high - low).max()) + 1))
    f = (first + step * (cell + 0.5) - s_first) / s_step - 0.5
    if kernel == "nearest":
        w = np.zeros(f.shape)
    elif kernel == "average":
        down, up = np.ceil(np.round(f - z / 2, 6)), np.ceil(np.round(f + z / 2, 6))
        w = ((at >= down) & (at <= np.maximum(down, up - 1))).astype(float)
    else:
        w = SPREAD[kernel]((at - f) / z)
    inside = cell <= high
    # the nearest pixel: halves go to the right and down
    return cell, np.where(inside, w, 0.0), inside & (np.floor(f + 0.5) == at)


def _spread(batch: pa.RecordBatch, keys: list[str], kernel: str) -> Iterator[pa.RecordBatch]:
    """Rows (keys, row, col, wv, w, n) of a batch of pixels with their rasters: what it adds to each cell."""
    x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in keys}
    cells, wc, nc = _along(x["sc"], x["a"], x["s_a"], x["c"], x["s_c"], x["width"], kernel)
    rows, wr, nr = _along(x["sr"], x["e"], x["s_e"], x["f"], x["s_f"], x["height"], kernel)
    size = cells.shape[1] * rows.shape[1]
    take = max(1, PAIRS // max(1, size))
    for i in range(0, batch.num_rows if size else 0, take):
        p = slice(i, i + take)
        w, near = wr[p, :, None] * wc[p, None, :], nr[p, :, None] & nc[p, None, :]
        k, r, c = np.nonzero((w != 0) | near)
        if not len(k):
            continue
        at, w, near = k + i, w[k, r, c], near[k, r, c]
        row, col, v = rows[at, r], cells[at, c], x["v"][at]
        order = np.lexsort((col, row, x["raster"][at]))
        at, row, col, w, near, v = (y[order] for y in (at, row, col, w, near, v))
        g = x["raster"][at]
        head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])]))
        n = np.fmax.reduceat(np.where(near, v, np.nan), head)
        found = np.logical_or.reduceat(near, head)
        owner = pa.array(at[head])
        own = [batch.column(key).take(owner) for key in keys]
        sums = [pa.array(np.add.reduceat(y, head)) for y in (w * v, w)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(row[head].astype(np.int32)), pa.array(col[head].astype(np.int32)), *sums, pa.array(n, mask=~found)], [*keys, "row", "col", "wv", "w", "n"])


def _scattered(pixels: DataFrame, rasters: DataFrame, keys: list[str], kernel: str, value: str) -> DataFrame:
    """Pixels spread their values over the cells that they count for. A raster's pixels come together for its grids, and what a batch of them adds to a cell is summed up before it moves."""
    small_batches(pixels.sparkSession)
    px = pixels.where(F.col(value).isNotNull()).select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).cast("double").alias("v"))
    grids = rasters.select(*keys, F.xxhash64(*keys).alias("raster"), "width", "height", *(F.col(c).cast("double").alias(c) for n in ("a", "c", "e", "f") for c in (n, f"s_{n}")))
    schema = T.StructType([px.schema[k] for k in keys] + [T.StructField(n, t) for n, t in (("row", T.IntegerType()), ("col", T.IntegerType()), ("wv", T.DoubleType()), ("w", T.DoubleType()), ("n", T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _spread(batch, keys, kernel)

    taps = px.join(grids.hint("merge"), keys).mapInArrow(run, schema)
    # every cell has a row, whatever counts for it
    none = _cells(rasters).select(*keys, "row", "col", *(F.lit(None).cast("double").alias(n) for n in ("wv", "w", "n")))
    sums = taps.unionByName(none).groupBy(*keys, "row", "col").agg(F.max("n").alias("n"), F.sum("wv").alias("wv"), F.sum("w").alias("w"))
    mean = F.col("n") if kernel == "nearest" else F.col("wv") / F.col("w")
    return sums.select(*keys, "row", "col", F.when(F.col("n").isNotNull(), mean).alias(value))


def _gathered(pixels: DataFrame, rasters: DataFrame, keys: list[str], kernel: str, value: str) -> DataFrame:
    """A cell's nearest pixel and the pixels under its kernel are looked up in one join, and brought together in one aggregation."""
    at = _places(rasters, keys, sized=kernel != "nearest")
    px = pixels.select(*keys, F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).cast("double").alias("v"))
    # the nearest pixel: halves go to the right and down
    near = F.struct(F.floor(F.col("fr") + 0.5).cast("int").alias("sr"), F.floor(F.col("fc") + 0.5).cast("int").alias("sc"))
    if kernel == "nearest":
        nearest = at.select(*keys, "row", "col", near.alias("t")).select(*keys, "row", "col", "t.*")
        return nearest.join(px.hint("merge"), [*keys, "sr", "sc"], "left").select(*keys, "row", "col", F.col("v").alias(value))
    if kernel == "average":
        half = lambda z: F.col(z) / 2
        span = lambda f, z: F.sequence(F.ceil(F.round(F.col(f) - half(z), 6)).cast("int"), F.greatest(F.ceil(F.round(F.col(f) - half(z), 6)), F.ceil(F.round(F.col(f) + half(z), 6)) - 1).cast("int"))
        weight = F.lit(1.0)
    else:
        radius, w = KERNELS[kernel]
        span = lambda f, z: F.sequence(F.ceil(F.col(f) - radius * F.col(z)).cast("int"), F.floor(F.col(f) + radius * F.col(z)).cast("int"))
        weight = w((F.col("sc") - F.col("fc")) / F.col("zc")) * w((F.col("sr") - F.col("fr")) / F.col("zr"))
    somewhere = F.col("fr").isNotNull() & F.col("fc").isNotNull()
    at = at.withColumn("near", F.when(somewhere, near))
    taps = at.select("*", F.explode_outer(F.when(somewhere, span("fr", "zr"))).alias("sr")).select("*", F.explode_outer(F.when(somewhere, span("fc", "zc"))).alias("sc"))
    taps = taps.select(*keys, "row", "col", "sr", "sc", weight.alias("w"), ((F.col("sr") == F.col("near.sr")) & (F.col("sc") == F.col("near.sc"))).alias("is_near"))
    # where the kernel leaves out the nearest pixel (average, half way), it comes in by a tap of its own, without weight; a cell whose place isn't known has one empty tap
    first = taps.where("w != 0 or is_near or sr is null")
    if kernel == "average":
        own = at.where(somewhere).select(*keys, "row", "col", F.col("near.sr").alias("sr"), F.col("near.sc").alias("sc"), F.lit(0.0).alias("w"), F.lit(True).alias("is_near"))
        first = first.withColumn("is_near", F.lit(False)).unionByName(own)
    met = first.join(px.hint("merge"), [*keys, "sr", "sc"], "left")
    sums = met.groupBy(*keys, "row", "col").agg(
        (F.sum(F.col("w") * F.col("v")) / F.sum(F.when(F.col("v").isNotNull() & (F.col("w") != 0), F.col("w")))).alias("m"), F.max(F.when(F.col("is_near"), F.col("v"))).alias("n"),
    )
    return sums.select(*keys, "row", "col", F.when(F.col("n").isNotNull(), F.col("m")).alias(value))


def resample_classes(pixels: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], target_keys: list[str], value: str = "scl", missing: int = 0) -> DataFrame:
    """Class codes: nearest only; cells that no source pixel covers get ``missing``."""
    x = resample(pixels, source, target, keys, target_keys, "nearest", value)
    return x.withColumn(value, F.when(F.col(value).isNull(), missing).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.rint(value)))).cast("int"))
