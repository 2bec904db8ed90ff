"""Exact repeated passages through a sparse suffix array.

A passage of ``LENGTH`` words that occurs twice holds, in both places, a suffix that starts at the
same word: the minimiser of its ``WIDTH`` runs of ``SEED`` words. Only suffixes at minimisers are
kept, about one in twenty. They are sorted, over the whole corpus, by their first words and then by their extents, and each is
compared with its neighbours; one whose neighbours differ is unique and goes.

A kept suffix stands for the passages of ``LENGTH`` words that have it as their minimiser. Together
they span its extent, the widest stretch to which a match at it may be extended left and right
before another minimiser takes over. Where a neighbour's extent is the same, the whole extent
is a match. Where the first words agree and the extents differ, one of each kind is extended word by word: its passages are
those that begin up to so many words to the left, and those that another kind of extent has too are matches.

Words, extents and passages are compared by two rolling hashes, 128 bits together; order is that of the hashes,
in which equal suffixes are neighbours as in any other order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.llm.common import WordHashes, chunks, discard, durable, map_texts, mixed, row_key, scratch, small_batches

LENGTH, SEED = 50, 10
WIDTH = LENGTH - SEED + 1
#: Bases of two rolling hashes over 64 bits; together 128 bits tell passages apart.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Powers:
    """Powers of the bases and of their inverses, as far as a text needs them."""

    def __init__(self):
        self.n, self.of = 0, []

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n > self.n:
            self.n = max(n, 2 * self.n)
            inverse = [np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES]
            start = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, b, np.uint64)]))
            self.of = [(start(b), start(i)) for b, i in zip(BASES, inverse, strict=True)]
        return self.of


class Stretches:
    """Hashes of any stretch of a text's words, from running sums."""

    def __init__(self, words: np.ndarray, powers: Powers):
        n = len(words)
        self.parts = [(np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n])]), down) for up, down in powers.upto(n)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        return [mixed((sums[ends] - sums[starts]) * down[starts]) for sums, down in self.parts]

    def seeds(self) -> np.ndarray:
        sums, down = self.parts[0]
        return mixed((sums[SEED:] - sums[:-SEED]) * down[: len(sums) - SEED])


def rightmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the least value of each ``width`` neighbours is, the rightmost of equal ones."""
    low, at, span = x, np.arange(len(x)), 1

    def joined(shift: int):
        right, left = low[shift:], low[: len(low) - shift]
        take = right <= left
        return np.where(take, right, left), np.where(take, at[shift:], at[: len(at) - shift])

    while 2 * span <= width:
        low, at = joined(span)
        span *= 2
    if span < width:
        low, at = joined(width - span)
    return at


def minimisers(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where suffixes are kept, and the first and last passage (by start) of each."""
    if len(seeds) < WIDTH:
        none = np.zeros(0, np.int64)
        return none, none, none
    at = rightmost_least(seeds, WIDTH)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:] - 1, [len(at) - 1]])


def suffixes(rows: DataFrame) -> DataFrame:
    """Rows (row, first, last, seed, x0, x1): the kept suffixes, the span of their passages, the hash of their first words, those of their extents."""

    def run(batches):
        hashes, powers = WordHashes(), Powers()
        for batch in batches:
            for piece in chunks(batch, "text"):
                parts = [[] for _ in range(6)]
                for row, text in zip(piece.column("row").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    words = hashes.of(text)
                    if len(words) < LENGTH:
                        continue
                    stretches = Stretches(words, powers)
                    seeds = stretches.seeds()
                    at, first, last = minimisers(seeds)
                    extents = [h.view(np.int64) for h in stretches.hashes(first, last + LENGTH)]
                    for part, x in zip(parts, (np.full(len(at), row), first, last, seeds[at].view(np.int64), *extents), strict=True):
                        part.append(x)
                kinds = (np.int64, np.int32, np.int32, np.int64, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *p]).astype(k)) for p, k in zip(parts, kinds, strict=True)], ["row", "first", "last", "seed", "x0", "x1"])

    return rows.select("row", "text").mapInArrow(run, "row long, first int, last int, seed long, x0 long, x1 long")


def neighbours(kept: DataFrame) -> DataFrame:
    """The rows of ``kept``, sorted, that resemble a neighbour: ``whole`` if its extent is the same, ``turn`` where the extent changes between neighbours
    with the same first words. The first and last row of a partition may have neighbours elsewhere; they count as turns."""
    order = ("seed", "x0", "x1", "row", "first")  # with the place, so that many copies of an extent are dealt to several partitions
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)

    def judged(part: pa.Table, before: pa.Table | None, after: pa.Table | None):
        """The rows of ``part``, between the row before and the row after."""
        n = part.num_rows
        around = [t for t in (before, part, after) if t is not None]
        seed, x0, x1 = (np.concatenate([t.column(c).to_numpy() for t in around]) for c in ("seed", "x0", "x1"))
        alike = seed[1:] == seed[:-1]
        equal = alike & (x0[1:] == x0[:-1]) & (x1[1:] == x1[:-1])
        whole, turn = np.zeros(n, bool), np.zeros(n, bool)
        lead = 0 if before is None else 1
        for flags, out in ((equal, whole), (alike & ~equal, turn)):
            out[1 - lead :] |= flags[: n - 1 + lead]  # with the row before
            out[: len(flags) - lead] |= flags[lead : lead + n]  # with the row after
        turn[0] |= before is None
        turn[-1] |= after is None
        return whole, turn

    def run(batches):
        waiting, before = None, None
        names = ["row", "first", "last", "x0", "x1"]

        def made(after):
            whole, turn = judged(waiting, before, after)
            out = waiting.select(names).append_column("whole", pa.array(whole)).append_column("turn", pa.array(turn))
            yield from out.filter(pa.array(whole | turn)).to_batches()

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                if waiting is not None:
                    yield from made(table.slice(0, 1))
                    before = waiting.slice(waiting.num_rows - 1)
                waiting = table
        if waiting is not None:
            yield from made(None)

    return ordered.mapInArrow(run, "row long, first int, last int, x0 long, x1 long, whole boolean, turn boolean")


def passages(rows: DataFrame, extents: DataFrame) -> DataFrame:
    """Rows (row, first, p0, p1): the passages of each extent (row, first, last), by start, with their hashes."""
    wanted = extents.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = rows.select("row", "text").join(wanted.hint("merge"), "row").select("row", "text", "spans")

    def run(batches):
        hashes, powers = WordHashes(), Powers()
        for batch in batches:
            for piece in chunks(batch, "text"):
                parts = [[np.zeros(0, k)] for k in (np.int64, np.int32, np.int64, np.int64)]
                for row, text, spans in zip(piece.column("row").to_pylist(), piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                    words = hashes.of(text)
                    starts = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans]))
                    p0, p1 = (h.view(np.int64) for h in Stretches(words, powers).hashes(starts, starts + LENGTH))
                    for part, x in zip(parts, (np.full(len(starts), row), starts.astype(np.int32), p0, p1), strict=True):
                        part.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["row", "first", "p0", "p1"])

    return joined.mapInArrow(run, "row long, first int, p0 long, p1 long")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row, spans): for each document that holds a passage of ``LENGTH`` words that
    occurs at another place too, in it or in another row, the stretches of words that such passages
    cover, as an array of (first, end), merged and in order.

    Words are ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased. ``row`` is the key of (doc_id, text);
    rows that repeat both count as separate places. Texts of fewer words, null texts and an empty
    table give no row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row", row_key("doc_id", "text"))
    small_batches(docs.sparkSession)
    with scratch() as hold:
        kept = durable(suffixes(rows), "suffixes")

        near = durable(neighbours(kept), "neighbours")
        discard(kept)
        whole = near.where("whole").select("row", "first", (F.col("last") + LENGTH).alias("end"))
        # a turn whose extent occurs again has whole copies beside it; it is there as a partner for others
        found = durable(passages(rows, near.where("turn").select("row", "first", "last")), "passages")
        again = found.groupBy("p0", "p1").agg(F.count("*").alias("n")).where("n > 1").select("p0", "p1")
        grown = found.join(durable(again, "repeated").hint("merge"), ["p0", "p1"], "left_semi").select("row", "first", (F.col("first") + LENGTH).alias("end"))
        stretches = whole.unionByName(grown).distinct()
        by_row = stretches.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("parts"))
        spans = hold(durable(merged(by_row), "spans"))
        ids = rows.select("doc_id", "row").distinct()
        return ids.join(spans.hint("merge"), "row").select("doc_id", "row", "spans")


def merged(by_row: DataFrame) -> DataFrame:
    """Overlapping and touching parts of each row, which are sorted, become one span."""

    def make():
        def work(piece):
            out = []
            for parts in piece.column("parts").to_pylist():
                spans: list[list[int]] = []
                for p in parts:
                    if spans and p["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], p["end"])
                    else:
                        spans.append([p["first"], p["end"]])
                out.append([{"first": a, "end": b} for a, b in spans])
            return [pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))]

        return work

    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return map_texts(by_row, "parts", ["row"], make, [T.StructField("spans", T.ArrayType(span))])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_repeated (words in spans) and spans.

    Documents without a repeated passage have an empty array. A null text has 0 words; null doc_ids
    keep their rows. Other columns are not read.
    """
    spans = repeated_spans(docs, doc_id, text).select("row", "spans").dropDuplicates(["row"])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    base = rows.select("doc_id", row_key("doc_id", "text").alias("row"), words.cast("long").alias("n_words"))
    joined = base.join(spans.hint("merge"), "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return joined.select("doc_id", "n_words", covered.alias("n_repeated"), "spans")
