"""Choosing scenes from a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.schemas import BAND_ORDER


def search(scenes: DataFrame, start, end, max_cloud: float, box: tuple[float, float, float, float] | None = None, required=BAND_ORDER, limit: int | None = None) -> DataFrame:
    """Scenes that overlap the box, within the dates, under the cloud limit, with all required assets; least cloud first, the first ``limit`` if given."""
    ok = F.col("ts").between(F.lit(start), F.lit(end)) & (F.col("cloud_cover_percent") < max_cloud)
    if box:
        ok = ok & (F.col("bbox.minx") <= box[2]) & (F.col("bbox.maxx") >= box[0]) & (F.col("bbox.miny") <= box[3]) & (F.col("bbox.maxy") >= box[1])
    if required:
        ok = ok & F.forall(F.lit(list(required)), lambda a: F.col("assets")[a].isNotNull())
    found = scenes.where(ok).orderBy("cloud_cover_percent", "item_id")
    return found.limit(limit) if limit else found


def ranked(candidates: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    """rank of each candidate within its keys: the preferred tile, then least cloud, then id."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("tile") == preferred, 0).otherwise(1), "cloud_cover_percent", "item_id")
    return candidates.withColumn("rank", F.row_number().over(w))


def contains(footprint: Column | str, x: Column, y: Column) -> Column:
    """Whether the point lies in the polygon or on its edge, by ray casting; NULL without a footprint of three points or more.

    ``footprint``: an array of structs (x, y), its first point repeated at the end or not. A ray to the right of the point meets the edges an odd number of times if it is inside.
    """
    ring = F.col(footprint) if isinstance(footprint, str) else footprint
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    turn = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    between = lambda v, k, e: (v >= F.least(e["a"][k], e["b"][k])) & (v <= F.greatest(e["a"][k], e["b"][k]))
    upward = lambda e: e["b"]["y"] > e["a"]["y"]
    # the edge spans the point's height, and lies to its right
    met = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (F.when(upward(e), turn(e) > 0).otherwise(turn(e) < 0))
    on_edge = F.exists(edges, lambda e: (turn(e) == 0) & between(x, "x", e) & between(y, "y", e))
    return F.when(F.size(ring) >= 3, on_edge | (F.size(F.filter(edges, met)) % 2 == 1))


def contains_box(footprint: Column | str, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether the polygon holds all four corners of the box."""
    inside = [contains(footprint, x, y) for x in (minx, maxx) for y in (miny, maxy)]
    return inside[0] & inside[1] & inside[2] & inside[3]


def pick(candidates: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    return ranked(candidates, keys, preferred).where("rank = 1").drop("rank")


def pick_containing(candidates: DataFrame, keys: list[str], preferred: Column, footprint: str = "footprint", box: str = "aoi_box") -> DataFrame:
    """The first of each ranking whose footprint holds the whole area ``box`` (minx, miny, maxx, maxy), with its ``rank`` among all candidates.

    Scenes that miss a corner, or have no footprint, are passed over; keys of which none holds the area give no row. Scenes, and not their pixels, are ranked.
    """
    b = [F.col(f"{box}.{k}") for k in ("minx", "miny", "maxx", "maxy")]
    holding = ranked(candidates, keys, preferred).where(contains_box(footprint, *b))
    return holding.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where("_n = 1").drop("_n")


def pick_pair(candidates: DataFrame, keys: list[str], preferred: Column, footprint: str | None = None, box: str = "aoi_box") -> DataFrame:
    """The before scene of each keys, and the after scene, for which the before scene's tile is preferred. With ``footprint``, the column of that name has to hold the area."""
    if footprint:
        b = [F.col(f"{box}.{k}") for k in ("minx", "miny", "maxx", "maxy")]
        candidates = candidates.where(contains_box(footprint, *b))
    before = pick(candidates.where("role = 'before'"), keys, preferred)
    tiles = before.select(*keys, F.col("tile").alias("before_tile"))
    after = candidates.where("role = 'after'").join(tiles.hint("merge"), keys)
    return before.unionByName(pick(after, keys, F.col("before_tile")).drop("before_tile"))
