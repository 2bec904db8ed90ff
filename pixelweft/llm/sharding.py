"""Histogram sort: equal shards by bytes.

Rows are ordered by a key of three uniform 62-bit parts: a hash of the text, a hash of the doc_id,
and a hash of the row's place. Exact bytes below candidate boundaries are counted over all
partitions at once; around each wanted boundary the candidates are then drawn ``PROBES`` times as close,
until the rows between two neighbours weigh less than the tolerance. Only then rows move, once.

Equal texts share the first part, so that a group of copies stays together unless a boundary falls
into a group heavier than the tolerance; then the second part (and for repeated rows the third)
splits it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.llm.common import durable

PARTS = ("k0", "k1", "k2")
#: Candidate boundaries around each open boundary in a round.
PROBES = 256
MOST_ROUNDS = 40



def _key(*values: Column) -> Column:
    """62 uniform bits, not negative."""
    return F.shiftrightunsigned(F.xxhash64(*values), 2)


def _below(boundary: tuple[int, ...]) -> Column:
    """True for rows whose key is below the boundary, given by its leading parts."""
    test = F.lit(False)
    for part, value in reversed(list(zip(PARTS, boundary, strict=False))):
        test = (F.col(part) < value) | ((F.col(part) == value) & test)
    return test


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """``shards - 1`` boundaries between which the sizes are near equal.

    A round counts rows and exact bytes between ``PROBES`` candidates spread over the interval of
    each boundary that is still open, all in one pass, and keeps the interval in which the wanted
    byte lies. At most ``PROBES`` rows for each open boundary come to the driver.
    """
    whole = keys.agg(F.sum("size").alias("s")).first()["s"] or 0
    allowed = tolerance * whole / shards
    found: dict[int, tuple[int, ...]] = {i: () for i in range(1, shards)} if not whole else {}
    # boundary -> (values of the parts before, lowest, highest of this part, exact bytes below)
    open_ = {i: ((), 0, (1 << 62) - 1, 0) for i in range(1, shards) if whole}
    for _ in range(MOST_ROUNDS):
        if not open_:
            break
        spans = sorted({x[:3] for x in open_.values()})
        which, probe = F.lit(None), F.lit(None)
        for n, (before, low, high) in enumerate(spans):
            part = F.col(PARTS[len(before)])
            inside = functools.reduce(lambda a, b: a & b, [F.col(p) == v for p, v in zip(PARTS, before, strict=False)], part.between(low, high))
            which = F.when(inside, n).otherwise(which)
            probe = F.when(inside, F.floor((part - low) / ((high - low) // PROBES + 1))).otherwise(probe)
        ranges = [f(c).alias(f"{f.__name__}_{c}") for c in PARTS for f in (F.min, F.max)]
        sums = keys.withColumn("w", which.cast("int")).where("w is not null").groupBy("w", probe.cast("long").alias("d")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), *ranges)
        counted = sorted(sums.collect(), key=lambda r: r["min_" + PARTS[len(spans[r["w"]][0])]])
        for i, (before, low, high, below) in list(open_.items()):
            want = whole * i / shards
            for r in (r for r in counted if spans[r["w"]] == (before, low, high)):
                if below + r["s"] >= want:
                    break
                below += r["s"]
            p = len(before)
            while True:
                least, most = r["min_" + PARTS[p]], r["max_" + PARTS[p]]
                if r["s"] <= allowed or r["n"] == 1 or (p == len(PARTS) - 1 and least == most):
                    found[i] = (*before, most + 1 if below + r["s"] - want < want - below else least)
                    del open_[i]
                    break
                if least < most:
                    open_[i] = (before, least, most, below)
                    break
                before, p = (*before, least), p + 1
    if open_:
        raise RuntimeError("boundaries did not settle")
    return [found[i] for i in range(1, shards)]


def histogram_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.002) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 bytes of the text plus 1; a null text has none, and counts like an empty
    one. Shards differ by at most about ``tolerance`` of their size, or by one row where a
    row is heavier than that. Slots count from 0 without a gap in each shard. Null and repeated
    doc_ids are rows like any other; an empty table gives an empty result. Other columns of ``docs``
    are not read.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        _key(F.coalesce(F.col(text), F.lit(""))).alias("k0"),
        _key(F.lit(1), F.col(doc_id)).alias("k1"),
        _key(F.lit(2), F.monotonically_increasing_id()).alias("k2"),
    )
    keys = durable(rows, "shard_keys")
    cuts = splitters(keys, shards, tolerance)
    shard = functools.reduce(lambda a, b: a + b, [F.when(_below(c), 0).otherwise(1) for c in cuts], F.lit(0))
    # the exchange: range partitions in key order, whose rows are numbered where they lie
    ordered = keys.withColumn("shard", shard.cast("int")).repartitionByRange(*PARTS).sortWithinPartitions(*PARTS)
    numbered = durable(ordered.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("m")), "ordered_rows")
    numbered = numbered.withColumn("piece", F.shiftright("m", 33))
    counts = numbered.groupBy("shard", "piece").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a row for each partition, and one more for each shard that begins inside one
    joined = numbered.join(F.broadcast(offsets), ["shard", "piece"])
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("m") - F.col("first")).cast("long").alias("slot"))
