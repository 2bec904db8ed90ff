"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is 8 bytes. Two that differ in at most 2 bits share at least 6 of their 8 positional
bytes. The index has a posting list for each value of four positional bytes (two of the four byte
pairs): 6 shared bytes always leave two whole byte pairs shared, so every such pair meets in a list.
The shared positional bytes of a pair that meets are tallied, pairs with fewer than 6 are dropped,
and the rest are verified bit by bit.

A list with many members doesn't emit its pairs. Its members share four bytes, so two of them link
exactly if some value of the other 32 bits is at most one bit from both: every member is posted under
the 33 values one bit around it, and those that meet there (33 at most) are joined in a chain.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.llm.common import components, durable, map_texts, scratch

SHINGLE, BITS = 3, 2
#: Bytes that a pair shares at least.
SHARED = 8 - BITS
#: Posting lists with more members are linked without emitting pairs.
LONG_LIST = 64
PAIRS = list(combinations(range(4), 2))
SLICE = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles, repeats included."""
    h = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), SLICE):
        ones += np.unpackbits(h[a : a + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with the fingerprint of each whole text, a long. Null
    texts, and texts without words, have 0."""
    return map_texts(docs, text, keep or docs.columns, lambda: lambda piece: [pa.array([fingerprint(t) for t in piece.column(text).to_pylist()], pa.int64())], [T.StructField(out, T.LongType())])


def _byte(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(255)


def _byte_pair(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(65535)


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Links ``(a, b)``, a < b, between distinct fingerprints, enough to connect all that differ in at most ``BITS`` bits."""
    lists = F.array(*(F.struct(F.lit(n).alias("list"), (_byte_pair(fp, i) * 65536 + _byte_pair(fp, j)).alias("bytes")) for n, (i, j) in enumerate(PAIRS)))
    index = distinct.select(F.col(fp).alias("f"), F.explode(lists).alias("p")).select("f", "p.*")
    long_lists = index.groupBy("list", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > LONG_LIST)
    marked = durable(index.join(long_lists.hint("merge"), ["list", "bytes"], "left"), "postings")

    short = marked.where("n is null")
    a, b = short.select("list", "bytes", F.col("f").alias("a")), short.select("list", "bytes", F.col("f").alias("b"))
    tally = sum((_byte("a", i) == _byte("b", i)).cast("int") for i in range(8))
    near = (
        a.hint("merge").join(b, ["list", "bytes"])
        .where(F.col("a") < F.col("b"))
        .where(tally >= SHARED)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
        .select("a", "b")
    )

    free = F.create_map(*(x for n, p in enumerate(PAIRS) for x in (F.lit(n), F.array(*(F.lit(16 * k + s) for k in range(4) if k not in p for s in range(16))))))
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(free[F.col("list")], lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s)))
    around = marked.where("n is not null").select("list", "bytes", "f", F.explode(flips).alias("flip")).select("list", "bytes", "f", F.col("f").bitwiseXOR(F.col("flip")).alias("at"))
    met = around.groupBy("list", "bytes", "at").agg(F.collect_set("f").alias("fs"))  # 33 members at most
    chained = met.where(F.size("fs") > 1).select(F.explode("fs").alias("b"), F.array_min("fs").alias("a")).where("a != b").select("a", "b")
    return near.unionByName(chained).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (long) and component_id, the smallest doc_id
    that is reachable over links between fingerprints that differ in at most ``BITS`` bits.

    Texts without words share fingerprint 0 and link like any other. A null doc_id keeps its row
    and is never a component_id while the component has another; repeated rows stay. An empty table
    gives an empty result. Other columns are not read.
    """
    with scratch() as keep:
        fps = keep(durable(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]), "fingerprints"))
        classes = classified(fps)
        ids = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes.hint("merge"), "fp").groupBy("component").agg(F.min("least").alias("component_id"))
        named = keep(durable(classes.join(ids.hint("merge"), "component").select("fp", "component_id"), "named_fingerprints"))
        return fps.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def classified(fps: DataFrame) -> DataFrame:
    """Rows (fp, component) of the distinct fingerprints; one without a link is its own component."""
    distinct = fps.select("fp").distinct()
    found = durable(components(links(distinct)), "fp_components")
    return distinct.join(found.select(F.col("node").alias("fp"), "component").hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, and of rows that repeat
    it the one whose text has the least hash. Rows that repeat both are one. A row without a doc_id stays only
    where its component has none with one. All columns pass through, whatever their names.
    """
    parts = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text)]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit(1), *parts).alias("r2"))
    with scratch() as keep:
        fps = durable(fingerprints(keyed.select("doc_id", "text", "r1", "r2"), keep=["doc_id", "r1", "r2"]), "fingerprints")
        classes = durable(classified(fps), "classes")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("first")
        kept = keep(durable(fps.join(classes.hint("merge"), "fp").groupBy("component").agg(first).select("first.r1", "first.r2"), "kept_rows"))
    return keyed.join(kept.hint("merge"), ["r1", "r2"]).select("doc", "r1", "r2").dropDuplicates(["r1", "r2"]).select("doc.*")
