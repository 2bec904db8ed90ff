"""Benchmark decontamination by a prefix-filtered set join.

An item gives windows of ``WINDOW`` consecutive words, a table of distinct windows. For a document to
contain a window it must contain all of the window's word shingles, so one of them, the prefix, is enough to find
candidates: the rarest by document frequency over the whole corpus. Occurrences of prefix
shingles in documents are joined with the windows on the shingle; the shingle's offset gives the window's place, the bounds
of the text are applied to it, and the words are compared exactly.

Documents are read twice, once to count shingles and once to look for prefixes, however large the benchmark is.
Tasks drop shingles that no window has by a bitmap of bounded size; what it lets through by chance finds no
partner in the join.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.llm.common import WordHashes, chunks, durable, map_texts, mixed, scratch, small_batches

WINDOW, SHINGLE = 13, 5
#: Bits of the bitmap: 16 for each shingle, but from 2^16 to 2^27 (16 MB).
LEAST_BITS, MOST_BITS = 16, 27
#: Fixed odd factors of the words of a shingle.
FACTORS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))
#: Digits, letters (lower-cased) and all bytes of non-ASCII characters stay; the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The codes of the k-word shingles from each place."""
    n = max(0, len(hashes) - k + 1)
    code = np.full(n, np.uint64(k))
    for i in range(k):
        code += hashes[i : i + n] * FACTORS[i]
    return mixed(code).view(np.int64)


def bitmap(codes: DataFrame) -> np.ndarray:
    """Bits, in longs, that are set at the last bits of each code."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * max(1, codes.count()) - 1).bit_length()))
    place = F.col("h").bitwiseAND((1 << bits) - 1)
    longs = codes.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v"))
    found = longs.toArrow()  # 2^(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return out


def among(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which codes may be among those that the bitmap was made of."""
    place = codes & np.int64(64 * len(bits) - 1)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


class Found:
    """Shingles of texts that a bitmap lets through."""

    def __init__(self, bits: Broadcast, sizes: list[int]):
        self.hashes, self.bits, self.sizes = WordHashes(words), bits.value, sizes

    def of(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts, where each text starts, and the end; places and codes of its shingles, in order."""
        each = [words(t) for t in texts]
        all_words = list(chain.from_iterable(each))
        starts = np.cumsum([0, *map(len, each)])
        h = np.fromiter(map(self.hashes.__getitem__, all_words), np.uint64, len(all_words))
        at, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.sizes:
            codes = shingles(h, k)
            places = np.flatnonzero(among(self.bits, codes))
            places = places[places + k <= starts[np.searchsorted(starts, places, "right")]]  # inside one text
            at.append(places)
            code.append(codes[places])
        at, code = np.concatenate(at), np.concatenate(code)
        order = np.argsort(at, kind="stable")
        return all_words, starts, at[order], code[order]


def windows(items: DataFrame) -> DataFrame:
    """Rows (item, n, k, win, shingles) of the items (i, t): windows of n words, joined by spaces, and the codes of their k-word shingles in order."""

    def run(batches):
        hashes = WordHashes(words)
        for batch in batches:
            for piece in chunks(batch, "t"):
                rows = []
                for item, text in zip(piece.column("i").to_pylist(), piece.column("t").to_pylist(), strict=True):
                    w, h = hashes.words_of(text)
                    n = min(WINDOW, len(w))
                    k = min(SHINGLE, n)
                    codes = shingles(h, k) if n else []
                    for a in range(len(w) - n + 1 if n else 0):
                        rows.append((item, n, k, b" ".join(w[a : a + n]).decode("utf-8", "replace"), codes[a : a + n - k + 1].tolist()))
                names = ["item", "n", "k", "win", "shingles"]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)

    return items.mapInArrow(run, "item string, n int, k int, win string, shingles array<long>")


def frequencies(docs: DataFrame, text: str, codes: DataFrame, bits: Broadcast, sizes: list[int]) -> DataFrame:
    """Rows (h, n): the document frequency of each code, over all documents."""

    def run(batches):
        found = Found(bits, sizes)
        for batch in batches:
            for piece in chunks(batch, text):
                _, starts, at, code = found.of(piece.column(0).to_pylist())
                text_of = np.searchsorted(starts, at, "right")
                order = np.lexsort((code, text_of))
                code, text_of = code[order], text_of[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (text_of[1:] != text_of[:-1])
                which, n = np.unique(code[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(n, pa.int64())], ["h", "n"])

    counted = docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return codes.join(counted.hint("merge"), "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n"))


def occurrences(docs: DataFrame, bits: Broadcast, sizes: list[int]) -> DataFrame:
    """``docs`` (doc, text) as rows (uid, doc, n_words, met): met has a code, its place, and the words around it, as many as a window may reach."""

    def make():
        found = Found(bits, sizes)

        def work(piece):
            w, starts, at, code = found.of(piece.column("text").to_pylist())
            text_of = np.searchsorted(starts, at, "right")
            first, end = starts[text_of - 1], starts[text_of]
            low, high = np.maximum(first, at - WINDOW + 1), np.minimum(end, at + WINDOW)
            around = [b" ".join(w[a:b]).decode("utf-8", "replace") for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            met = pa.StructArray.from_arrays([pa.array(code), pa.array((at - first).astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(around, pa.string())], ["h", "at", "before", "around"])
            ends = np.searchsorted(at, starts).astype(np.int32)
            return [pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(ends), met)]

        return work

    kind = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("around", T.StringType())]))
    out = map_texts(docs, "text", ["doc"], make, [T.StructField("n_words", T.LongType()), T.StructField("met", kind)])
    return durable(out.withColumn("uid", F.monotonically_increasing_id()), "prefix_occurrences")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with n_words, n_hit, item_ids (array of string, sorted) and contaminated.

    A word is hit if it lies in an occurrence of an item's window; a document is contaminated if it
    has a hit word and the hit words are at least ``share`` of its words. Null and empty texts have
    no words and are clean. Items without an id or without words are left out; items that
    repeat an id count once. An empty benchmark hits nothing; an empty ``docs`` gives an empty result; repeated rows
    are judged each. Columns of ``docs`` that have the names of results are replaced; other names don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in keep or docs.columns if c not in ("n_words", "n_hit", "item_ids", "contaminated")]
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    with scratch() as hold:
        owners = durable(windows(items), "item_windows")
        distinct = durable(owners.groupBy("n", "win").agg(F.first("k").alias("k"), F.first("shingles").alias("shingles")).withColumn("wid", F.monotonically_increasing_id()), "windows")
        owners = durable(owners.select("n", "win", "item").distinct().join(distinct.select("n", "win", "wid").hint("merge"), ["n", "win"]).select("wid", "item"), "owners")
        sizes = [r["k"] for r in distinct.select("k").distinct().collect()]  # SHINGLE at most

        codes = durable(distinct.select(F.explode("shingles").alias("h")).distinct(), "shingles")
        counted = durable(frequencies(docs, text, codes, spark.sparkContext.broadcast(bitmap(codes)), sizes), "frequencies")
        rarest = distinct.select("wid", F.posexplode("shingles").alias("offset", "h")).join(counted.hint("merge"), "h")
        rarest = rarest.groupBy("wid").agg(F.min(F.struct("n", "h", "offset")).alias("r")).select("wid", "r.h", "r.offset")
        prefixes = durable(rarest.join(distinct.select("wid", "n", "win").hint("merge"), "wid"), "prefixes")

        bits = spark.sparkContext.broadcast(bitmap(prefixes.select("h").distinct()))
        packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), F.col(text).alias("text"))
        base = hold(occurrences(packed, bits, sizes))
        # a table, so that Spark can split a very common shingle in the join
        met = durable(base.where("size(met) > 0").select("uid", F.inline("met")), "occurrences")
        start = F.col("before") - F.col("offset")
        inside = (start >= 0) & (F.array_join(F.slice(F.split("around", " "), start + 1, F.col("n")), " ") == F.col("win"))
        found = met.join(prefixes.hint("merge"), "h").where(inside).select("uid", (F.col("at") - F.col("offset")).alias("first"), "n", "wid")
        found = durable(found, "found_windows")

        by_place = Window.partitionBy("uid").orderBy("first", "end")
        spans = found.select("uid", "first", (F.col("first") + F.col("n")).alias("end")).distinct()
        reached = F.coalesce(F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hits = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("first", reached))).groupBy("uid").agg(F.sum("new").alias("n_hit"))
        ids = found.select("uid", "wid").distinct().join(owners.hint("merge"), "wid").groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
        hits = hold(durable(hits.join(ids.hint("merge"), "uid"), "hits"))

    none = F.array().cast("array<string>")
    some = base.where("size(met) > 0").select("uid", "doc", "n_words").join(hits.hint("merge"), "uid", "left")
    some = some.select("doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))
    rest = base.where("size(met) = 0").select("doc", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"))
    per = round(1 / share)
    return some.unionByName(rest).select("doc.*", "n_words", "n_hit", "item_ids", ((F.col("n_hit") > 0) & (per * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
