"""Ranks and medians within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.storage import durable, scratch

#: Bins of a pass over the values, values of a bin that are sorted at last, passes after which all that is left is range-sorted, groups whose bins are small enough to be sent to all tasks (their rows are of fixed width).
BINS, SORTED, LEVELS, SENT = 4096, 1 << 18, 6, 50_000


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their rank, from 1, among the rows that agree in ``by``.

    Rows are range-sorted by group and order and numbered where they lie, so a large group is dealt to
    several tasks; what comes before in other partitions is added from a row for each group and partition.
    Ties are broken in any way, but consistently: the sorted rows are a table.
    """
    keys = [F.col(c) for c in by]
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = durable(ordered.withColumn("_m", F.monotonically_increasing_id()), "sorted_rows").withColumn("_piece", F.shiftright("_m", 33))
    spans = numbered.groupBy(*by, "_piece").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    # as many rows as a group has partitions
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = (F.col("a._piece") == F.col("b._piece")) & F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rank = (F.col("b._before") + F.col("a._m") - F.col("b._first") + 1).cast("long").alias(name)
    return numbered.alias("a").join(spans.alias("b").hint("merge"), same).select(*(F.col(f"a.{c}").alias(c) for c in rows.columns if c != name), rank)


def medians(rows: DataFrame, by: list[str], value: str, name: str = "median", bins: int = BINS, sort: int = SORTED) -> DataFrame:
    """One row for each group with a value: ``by`` and its median, the mean of the two middle values if their number is even.

    By counting: a pass counts the values of each group between equally spaced bounds, and only the bins in which the middle values lie are
    read again, until few enough are left to be sorted. Null and NaN values don't count. Nothing is sorted or moved but partial counts and these bins.
    """
    x = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    with scratch() as keep:
        ends = x.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
        lo, hi = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0.0, 0.0)
        lo, hi = max(lo, -1e308), min(hi, 1e308)
        x, group = x.withColumn("_bin", _bin(F.lit(lo), F.lit(max(hi, lo + 1e-300)), bins)), [*by]
        want = done = None
        for level_ in range(LEVELS + 1):
            counted = x.groupBy(*group, "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            over = Window.partitionBy(*group).orderBy("_bin")
            counted = counted.withColumn("_upto", F.sum("_n").over(over))
            if want is None:
                total = F.sum("_n").over(Window.partitionBy(*group))
                counted = counted.withColumn("_all", total).withColumn("_k", F.explode(F.expr("array((_all + 1) div 2, (_all + 2) div 2)")))
            else:
                counted = _met(counted, want, group)
            here = counted.where((F.col("_k") > F.col("_upto") - F.col("_n")) & (F.col("_k") <= F.col("_upto")))
            here = here.select(*group, "_bin", (F.col("_k") - F.col("_upto") + F.col("_n")).cast("long").alias("_k"), "_n", "_lo", "_hi")
            here = durable(here, "middle_bins")
            one = here.where("_lo = _hi").select(*by, F.col("_lo").alias("_v"))
            done = one if done is None else done.unionByName(one)
            want = here.where("_lo < _hi")
            facts = want.agg(F.count("*").alias("c"), F.max("_n").alias("n")).first()
            if not facts["c"]:
                break
            chosen = want.groupBy(*group, "_bin").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
            chosen = F.broadcast(chosen) if facts["c"] <= SENT else chosen.hint("merge")
            x = durable(_same(x, chosen, [*group, "_bin"]), "middle_values")
            # a bin becomes a group of its own
            level = f"_bin{len(group)}"
            x, want, group = x.withColumnRenamed("_bin", level), want.withColumnRenamed("_bin", level).drop("_lo", "_hi", "_n"), [*group, level]
            if facts["n"] <= sort or level_ == LEVELS:
                numbered = x.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_v"))) if facts["n"] <= sort else ranked(x, group, [F.col("_v")], "_r")
                done = done.unionByName(_met(numbered, want, group).where("_r = _k").select(*by, "_v"))
                break
            x = x.withColumn("_bin", _bin(F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")
        out = keep(durable(done.groupBy(*by).agg(F.avg("_v").alias(name)), "medians"))
    return out


def _bin(lo: Column, hi: Column, bins: int) -> Column:
    """Of ``_v``: its place between the bounds. Infinite values are in the first or last bin."""
    share = F.nanvl((F.col("_v") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(bins - 1)), share)).cast("long")


def _on(group: list[str]) -> Column:
    same = F.lit(True)
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return same


def _same(rows: DataFrame, chosen: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` whose group is chosen, with its other columns."""
    more = [c for c in chosen.columns if c not in group]
    return rows.alias("a").join(chosen.alias("b"), _on(group)).select("a.*", *(f"b.{c}" for c in more))


def _met(rows: DataFrame, want: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with the places wanted of their group: a row for each."""
    return rows.alias("a").join(want.alias("b").hint("merge"), _on(group)).select("a.*", "b._k")
