"""Ranked lexical search: an Aho-Corasick scan of whole documents, without an index of them.

The terms of all items form one automaton. A text is brought to the form `` term term term `` (all that is
not part of a term becomes a space), and every term of the automaton is guarded by a space on either side, so that
whole terms only are found. Two scans read the documents: one counts how many hold each term and how
many terms there are, the other scores. In the second, each task keeps the best documents of every item that it has
seen, and two rounds of ranking bring those of all tasks together.

Items whose terms take more than ``BLOCK`` bytes together are dealt to blocks, and each block scans the documents by itself: an
automaton, and what is broadcast, has a bound whatever the number of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweft.llm.common import chunks, durable, scratch, small_batches

#: Bytes of item terms that an automaton holds, cells of a table of scores, bytes that the automaton reads at a time, parts of an item's candidates.
BLOCK, CELLS, PIECE, PARTS = 2 << 20, 2 << 20, 1 << 20, 32
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Of each byte: itself if it belongs to a term, A-Z lower-cased, all others a space. Bytes of other scripts are term bytes.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> Column:
    """The distinct terms of a text, A-Z lower-cased."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, NO_TERM), lambda t: t != ""))


def item_blocks(items: DataFrame, item_id: str, text: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Rows (item, terms, block), and how many blocks there are. Rows of one item are one item with the terms of all."""
    found = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), terms_of(text).alias("terms"))
    found = found.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    found = durable(found.where(F.size("terms") > 0).withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 2)), "items")
    total = found.agg(F.sum("bytes")).first()[0] or 0
    n = max(1, -(-total // block))
    while True:
        dealt = found.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)).cast("long"))
        most = dealt.groupBy("block").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).where(f"n > 1 and b > {2 * block}").limit(1).count()
        if not most:
            return dealt.select("item", "terms", "block"), n
        n *= 2


class Scan:
    """The automaton of a block's terms. ``tally`` finds them in texts."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.n = len(terms)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(terms):
            self.automaton.add_word(f" {t.encode().decode('latin-1')} ", i)
        if terms:
            self.automaton.make_automaton()

    def tally(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms with repeats in each text; and, ordered by text, (text, term of the automaton, occurrences)."""
        clean = [(t or b"").translate(CLEAN) for t in texts]
        starts = np.cumsum([1, *(len(t) + 1 for t in clean)])[:-1]
        joined = b" " + b" ".join(clean) + b" "
        n, keys, counts = np.zeros(len(texts), np.int64), [], []
        a = 0
        while a < len(joined) - 1:
            # a piece begins and ends with a space, which the next one shares
            b = len(joined) - 1 if len(joined) - a <= PIECE else joined.rfind(b" ", a + 1, a + PIECE)
            b = b if b > 0 else joined.find(b" ", a + PIECE)
            piece = joined[a : b + 1]
            blank = np.frombuffer(piece, np.uint8) == 32
            first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1 + a
            n += np.bincount(np.searchsorted(starts, first, "right") - 1, minlength=len(texts))
            if self.n:
                found = np.fromiter(self.automaton.iter(piece.decode("latin-1")), [("end", np.int64), ("term", np.int64)])
                text = np.searchsorted(starts, found["end"] + (a - 1), "right") - 1
                k, c = np.unique(text * self.n + found["term"], return_counts=True)
                keys.append(k), counts.append(c)
            a = b
        if not keys:
            none = np.zeros(0, np.int64)
            return n, none, none, none
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.zeros(len(k), np.int64)
        np.add.at(c, at, np.concatenate(counts))
        return n, k // self.n, k % self.n, c


def _texts(piece: pa.RecordBatch) -> list[bytes | None]:
    return pc.cast(piece.column("text"), pa.large_binary()).to_pylist()


def counted(docs: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and documents that hold each of ``terms``: one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(terms)
        df, some, all_ = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for piece in chunks(batch, "text"):
                n, _, term, _ = scan.tally(_texts(piece))
                df += np.bincount(term, minlength=len(terms))
                some, all_ = some + int((n > 0).sum()), all_ + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at], pa.int64()), pa.array([some, all_, *df[at]], pa.int64())], ["term", "n"])

    rows = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the block has terms
    found = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist(), strict=True))
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(terms))], np.int64)


class Best:
    """The ``k`` best documents of each item among those that were offered. A missing id comes after all others."""

    def __init__(self, items: int, k: int):
        self.k, self.limit = k, 2 * items * k + (1 << 16)
        self.least = np.ones(items, np.int64)
        self.rows = np.zeros((0, 4), np.int64)  # item, score, id missing, id
        self.more: list[np.ndarray] = []
        self.held = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        d, i = np.nonzero(scores >= self.least)
        self.more.append(np.stack([i, scores[d, i], missing[d], ids[d]], 1))
        self.held += len(d)
        if self.held > self.limit:
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.more])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        last = rows[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]
        self.rows, self.more, self.held = rows[place < self.k], [], 0
        return self.rows


def ranked_block(docs: DataFrame, block: pa.Table, item_type: T.DataType, k: int) -> DataFrame:
    """Rows (item, doc, score): of each task, the best documents of each item of a block."""
    items = block["item"].combine_chunks()
    lists = block["terms"].to_pylist()
    terms = sorted({t for one in lists for t in one})
    number = {t: i for i, t in enumerate(terms)}
    n_docs, n_terms, df = counted(docs, terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    holds = np.array([len(one) for one in lists])
    owner = np.repeat(np.arange(len(lists)), holds)[order := np.argsort(flat := np.array([number[t] for one in lists for t in one]), kind="stable")]
    ends = np.cumsum(np.bincount(flat[order], minlength=len(terms)))
    begins = ends - np.bincount(flat, minlength=len(terms))
    step = max(1, CELLS // len(lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, best = Scan(terms), Best(len(lists), k)
        for batch in batches:
            for piece in chunks(batch, "text"):
                for a in range(0, piece.num_rows, step):
                    part = piece.slice(a, step)
                    n, text, term, tf = scan.tally(_texts(part))
                    m = 100 - 50 + (50 * n * n_docs) // max(1, n_terms)
                    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[text]))
                    many = ends[term] - begins[term]
                    at = np.repeat(begins[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    scores = np.zeros((part.num_rows, len(lists)), np.int64)
                    np.add.at(scores.reshape(-1), np.repeat(text, many) * len(lists) + owner[at], np.repeat(value, many))
                    doc = part.column("doc")
                    best.offer(scores, pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        rows = best.settle()
        for a in range(0, len(rows), 1 << 16):
            r = rows[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([items.take(pa.array(r[:, 0])), pa.array(r[:, 3], pa.int64(), mask=r[:, 2] == 1), pa.array(r[:, 1], pa.int64())], ["item", "doc", "score"])

    return docs.mapInArrow(run, T.StructType([T.StructField("item", item_type), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())]))


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank (from 1), doc_id (long), score (long, above 0).

    Equal scores go by ascending doc_id, those without an id last; each row of ``docs`` is a document, whatever ids
    repeat. Null and empty texts have no terms. Rows of ``items`` that share an id are one item with the terms of all, rows without an id
    are none, and an item without terms, or none of whose terms occur, has no rows. Other columns are ignored, whatever their names. Texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    with scratch() as keep:
        dealt, n = item_blocks(items, item_id, item_text, block)
        item_type, found = dealt.schema["item"].dataType, None
        for b in range(n):
            rows = dealt.where(F.col("block") == b).select("item", "terms").toArrow()  # at most two times ``block`` bytes, or one item
            if rows.num_rows:
                one = keep(durable(ranked_block(docs, rows, item_type, k), "best_of_tasks"))
                found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item", item_type), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())]))
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    part = found.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_id), "rank", F.col("doc").alias("doc_id"), "score")
