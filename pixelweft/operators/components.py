"""Connected components of a graph of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweft.storage import discard, durable, scratch


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Distributed union-find over links ``(a, b)`` of longs: one row ``(node, component)`` for
    each node that has a link, where ``component`` is the smallest node that it reaches.

    Alternates the large-star and small-star steps (Kiveris et al., SoCC 2014) until the link
    set no longer changes. Each round is written to the shared folder. Null ends and loops are
    ignored; an empty input gives an empty result.
    """
    with scratch() as keep:
        links = keep(_settled(edges, a, b, max_rounds))
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _settled(edges: DataFrame, a: str, b: str, max_rounds: int) -> DataFrame:
    """The links when they no longer change: each node to the least of its component."""
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    links = durable(links, "links")
    stamp = _stamp(links)
    for _ in range(max_rounds):
        if not stamp[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table, so that Spark can split a node with very many links in the join
        low = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = (
            both.join(low.hint("merge"), "u")
            .where("v > u and v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.where("u != m").select("u", F.col("m").alias("v")))
            .distinct()
        )
        high = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(high.hint("merge"), "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(high.select("u", F.col("m").alias("v")))
            .distinct()
        )
        last, links = links, durable(small, "links")
        before, stamp = stamp, _stamp(links)
        discard(last, low)
        if stamp == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links
