"""Change patches: 8-connected components of changed pixels, in two levels.

Changed pixels of a row that touch are one run. Runs are cut at the borders of tiles, and each tile is labelled
by itself, a bounded piece of work whatever the size of the scene. What touches across a border joins the labels of two tiles, and distributed
union-find over these contacts alone gives the patches. Only pixels on borders are looked up, each at three places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.operators.components import components
from pixelweft.storage import durable

#: Rows and columns of a tile.
TILE = (256, 1024)
MIN_PIXELS, LARGE_HA = 4, 1.0


def runs(changed: DataFrame) -> DataFrame:
    """Rows (scene_id, row, c0, c1, len, run) from rows (scene_id, row, col) of changed pixels."""
    at = Window.partitionBy("scene_id", "row").orderBy("col")
    islands = changed.select("scene_id", "row", "col", (F.col("col") - F.row_number().over(at)).alias("island"))
    found = islands.groupBy("scene_id", "row", "island").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("len")).drop("island")
    return found.withColumn("run", F.xxhash64("scene_id", "row", "c0"))


def _label_tile(tile: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one tile with the least piece that each is connected to inside it."""
    tile = tile.sort_values(["row", "c0"], ignore_index=True)
    row, c0, c1 = (tile[c].to_numpy() for c in ("row", "c0", "c1"))
    parent = list(range(len(tile)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # of each piece: the pieces of the row above that it touches are neighbours in order
    above = np.searchsorted(row, row - 1), np.searchsorted(row, row)
    for i in range(len(tile)):
        lo, hi = above[0][i], above[1][i]
        j = lo + np.searchsorted(c1[lo:hi], c0[i] - 1)
        while j < hi and c0[j] <= c1[i] + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
            j += 1
    piece = tile["piece"].to_numpy()
    tile["label"] = piece[[find(i) for i in range(len(tile))]] if len(tile) else piece
    return tile[["scene_id", "row", "c0", "c1", "run", "piece", "label"]]


def _contacts(pieces: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """Rows (a, b) of labels that touch across a border of tiles."""
    high, wide = tile
    row, col = F.col("row"), F.col("col")
    steps = lambda dr, dc: F.struct((row + dr).alias("row"), (col + dc).alias("col"))
    span = F.sequence("c0", "c1")
    at = lambda rows, cols: rows.select("scene_id", "row", F.explode(cols).alias("col"), "label")
    top, bottom = pieces.where(row % high == 0), pieces.where(row % high == high - 1)
    left, right = pieces.where(F.col("c0") % wide == 0), pieces.where(F.col("c1") % wide == wide - 1)
    asked = at(top, span).select("scene_id", "label", F.explode(F.array(*(steps(-1, d) for d in (-1, 0, 1)))).alias("p")).unionByName(
        at(left, F.array("c0")).select("scene_id", "label", F.explode(F.array(*(steps(d, -1) for d in (-1, 0, 1)))).alias("p")))
    there = at(bottom, span).unionByName(at(right, F.array("c1"))).distinct()
    asked = asked.select("scene_id", F.col("label").alias("a"), "p.*")
    return asked.join(there.withColumnRenamed("label", "b").hint("merge"), ["scene_id", "row", "col"]).select("a", "b").distinct()


def label(found: DataFrame, tile: tuple[int, int] = TILE) -> DataFrame:
    """Rows (scene_id, run, len, patch): the patch of each run of ``runs``.

    Scenes have any size and shape; no task sees more than the runs of a tile. Rows with a null scene, row or column are of no scene and must not be given.
    """
    high, wide = tile
    over = F.explode(F.sequence(F.expr(f"c0 div {wide}"), F.expr(f"c1 div {wide}"))).alias("tile_col")
    cut = found.select("scene_id", "row", "c0", "c1", "run", "len", over)
    cut = cut.select("scene_id", "row", "run", F.greatest("c0", F.col("tile_col") * wide).alias("c0"), F.least("c1", F.col("tile_col") * wide + wide - 1).alias("c1"), F.expr(f"row div {high}").alias("tile_row"), "tile_col")
    cut = cut.withColumn("piece", F.xxhash64("scene_id", "row", "c0"))
    kinds = {c: cut.schema[c].dataType.simpleString() for c in ("scene_id", "row", "c0", "c1")}
    schema = f"scene_id {kinds['scene_id']}, row {kinds['row']}, c0 {kinds['c0']}, c1 {kinds['c1']}, run long, piece long, label long"
    pieces = durable(cut.groupBy("scene_id", "tile_row", "tile_col").applyInPandas(_label_tile, schema), "pieces")
    known = components(_contacts(pieces, tile))
    # all pieces of a run are connected: the first stands for it
    size = pieces.groupBy("scene_id", "run").agg(F.min_by("label", "c0").alias("label"), F.sum(F.col("c1") - F.col("c0") + 1).cast("long").alias("len"))
    return size.join(known.withColumnRenamed("node", "label").hint("merge"), "label", "left").select("scene_id", "run", "len", F.coalesce("component", "label").alias("patch"))


def patch_sizes(labelled: DataFrame, pixel_m2: float = 100.0, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Rows (scene_id, patch, pixels, area_ha) of the patches that aren't noise."""
    sizes = labelled.groupBy("scene_id", "patch").agg(F.sum("len").alias("pixels")).where(F.col("pixels") >= min_pixels)
    return sizes.withColumn("area_ha", F.round(F.col("pixels") * pixel_m2 / 10_000.0, 4))


def patch_stats(sizes: DataFrame, pixel_m2: float = 100.0) -> DataFrame:
    """patch_count, mean, max and large patches, and the sizes from the largest, for each scene that has a patch."""
    return sizes.groupBy("scene_id").agg(
        F.count("*").alias("patch_count"), F.round(F.avg("area_ha"), 4).alias("mean_patch_area_ha"), F.max("area_ha").alias("max_patch_area_ha"),
        F.count_if(F.col("pixels") * pixel_m2 / 10_000.0 >= LARGE_HA).alias("large_patch_count"), F.sort_array(F.collect_list("area_ha"), asc=False).alias("patch_sizes_ha"),
    )
