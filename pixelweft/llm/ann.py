"""Approximate nearest neighbours by largest inner product, with a forest of random-projection trees.

A node of a tree parts its vectors at the median of their projections on the line through two of
them, drawn at random. The forest is built on a bounded sample; every vector is then dropped down
all trees into leaves, so the index holds every row. A search walks all trees through one priority
queue, always going on where the query is farthest on the right side of the planes passed, until it has
enough leaves. Leaf by leaf, queries meet the vectors, and inner products in double
precision on the original vectors rank them.

Equal vectors are one node with their smallest ids, as many as an answer can use, so that a large
group of copies costs no more than one vector.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweft.llm.common import durable

#: Vectors that the forest is built on at most, its trees, vectors of the sample in a leaf, leaves that a search takes.
SAMPLE, TREES, LEAF, PROBES = 40_000, 16, 1024, 56
#: Vectors, and queries, that meet in one group, about; pairs whose scores are worked out at a time.
GROUP, PAIRS = 4096, 1 << 16


class Tree:
    """Nodes from 0 (the root): plane, threshold, children; a child below 0 is leaf ``-1 - child``."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        planes, cuts, children = [], [], []
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = rng.choice(len(rows), 2, replace=False)
                    plane = x[rows[a]] - x[rows[b]]
                    along = x[rows] @ plane
                    cut = float(np.median(along))
                    right = along > cut
                    if right.any() and not right.all():
                        n = len(planes)
                        planes.append((plane / np.linalg.norm(plane)).astype(np.float32))
                        cuts.append(cut / float(np.linalg.norm(plane)))
                        children.append([0, 0])
                        children[n] = [grow(rows[~right]), grow(rows[right])]
                        return n
            self.leaves += 1
            return -self.leaves

        self.root = grow(np.arange(len(x)))
        self.planes = np.array(planes, np.float32).reshape(-1, x.shape[1])
        self.cuts, self.children = np.array(cuts, np.float32), children

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                right = x[rows] @ self.planes[node] > self.cuts[node]
                todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out


def search(trees: list[Tree], sizes: list[np.ndarray], q: np.ndarray, probes: int, least: int) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order in which one queue over all trees comes to them: at least
    ``probes`` of them, and on until those of one tree hold ``least`` vectors."""
    queue = [(-np.inf, t, tree.root) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    found, held = [], [0] * len(trees)
    margins = [tree.planes @ q - tree.cuts for tree in trees]
    while queue and (len(found) < probes or max(held) < least):
        far, t, node = heapq.heappop(queue)
        while node >= 0:
            m = float(margins[t][node])
            left, right = trees[t].children[node]
            heapq.heappush(queue, (max(far, m), t, left) if m > 0 else (max(far, -m), t, right))
            node = right if m > 0 else left
        found.append((t, -1 - node))
        held[t] += int(sizes[t][-1 - node])
    return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.to_pylist() if len(column) == 0 else column
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def lifted(x: np.ndarray, peak: float, top: float, query: bool = False) -> np.ndarray:
    """One more component turns the largest inner product into the nearest direction. ``peak`` is the largest component of all, so that squares neither vanish nor overflow; ``top`` the largest sum of squares of such shares."""
    x = x / peak
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, top - (x * x).sum(1)))
    return np.concatenate([x, more[:, None]], 1).astype(np.float32)


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (vec_id, e, k0, k1) that take part: no null, zero or non-finite component, and of the most frequent length."""
    e = F.col(embedding).cast("array<double>")
    whole = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"), whole.alias("ok")).where("vec_id is not null and ok")
    common = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    peak = F.array_max(F.transform(F.col("e").cast("array<double>"), lambda v: F.abs(v)))
    return rows.where(F.size("e") == (common["n"] if common else 0)).select("vec_id", "e", peak.alias("peak"), F.xxhash64("e").alias("k0"), F.xxhash64(F.lit(1), "e").alias("k1"))


def best_pairs(a: np.ndarray, b: np.ndarray, least: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, score): for each row of ``a`` its ``m`` largest inner products, ties to the smaller ``least``. However many are equal, these are the right ones."""
    found = []
    m = min(m, len(b))
    size = np.sqrt((b * b).sum(1)).max()
    step = max(1, PAIRS // len(b))
    for first in range(0, len(a), step):
        part = a[first : first + step]
        rough = part @ b.T
        edge = np.partition(rough, len(b) - m, axis=1)[:, len(b) - m]
        # what rounding could lift over the edge stays in
        slack = 1e-12 * b.shape[1] * np.sqrt((part * part).sum(1)) * size
        i, j = np.nonzero(~(rough < (edge - slack)[:, None]))
        score = np.concatenate([np.multiply(part[i[k : k + PAIRS]], b[j[k : k + PAIRS]]).sum(1) for k in range(0, len(i), PAIRS)])
        order = np.lexsort((least[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[place < m] + first, j[place < m], score[place < m]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, probes: int = PROBES, seed: int = 11) -> DataFrame:
    """The ``k`` nearest found for each row for which ``is_query`` (a condition on vec_id) holds:
    query_id, rank (from 1), vec_id, score.

    Candidates are all rows but those with the query's own id; ties go to the smaller vec_id. Vectors
    that are null, zero, of another length than most, or hold null or non-finite components take no
    part, nor do rows without an id; components of any size do. A row that is there twice counts once. With fewer candidates than
    ``k`` all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = durable(valid_vectors(vectors, vec_id, embedding), "vectors")
    ids = rows.select("k0", "k1", "vec_id").distinct()
    by_id = Window.partitionBy("k0", "k1").orderBy("vec_id")
    kept = ids.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1).groupBy("k0", "k1").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kept = durable(kept, "smallest_ids")
    distinct = rows.groupBy("k0", "k1").agg(F.min("e").alias("e"), F.min("vec_id").alias("least"), F.max("peak").alias("peak"), F.max(is_query).alias("asks"))
    distinct = durable(distinct, "distinct_vectors")

    facts = distinct.agg(F.count("*").alias("n"), F.max("peak").alias("peak"), F.sum(F.col("asks").cast("int")).alias("q")).first()
    n, peak, q = facts["n"], facts["peak"], facts["q"] or 0
    if n and q:
        share = F.aggregate(F.col("e").cast("array<double>"), F.lit(0.0), lambda s, v: s + (v / peak) * (v / peak))
        top = distinct.agg(F.max(share)).first()[0]
    if not n or not q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = distinct if n <= sample else distinct.where(F.pmod("k0", F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    drawn = lifted(_matrix(part.orderBy("k0", "k1").select("e").limit(sample).toArrow()["e"]), peak, top)
    rng = np.random.default_rng(seed)
    forest = [Tree(drawn, leaf, rng) for _ in range(trees)]

    def index(batches):
        for b in batches:
            x = lifted(_matrix(b.column("e")), peak, top)
            for t, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(tree.leaf_of(x)), *(b.column(c) for c in ("k0", "k1", "least", "e"))], ["tree", "leaf", "k0", "k1", "least", "e"])

    e_type = distinct.schema["e"].dataType.simpleString()
    indexed = durable(distinct.select("k0", "k1", "least", "e").mapInArrow(index, f"tree int, leaf int, k0 long, k1 long, least long, e {e_type}"), "leaves")
    sizes = [np.zeros(tree.leaves, np.int64) for tree in forest]
    for r in indexed.groupBy("tree", "leaf").count().collect():  # as many rows as the forest has leaves
        sizes[r["tree"]][r["leaf"]] = r["count"]
    leaves = sum(tree.leaves for tree in forest)
    parts = max(1, round(q * min(probes, leaves) / leaves / GROUP))

    def ask(batches):
        for b in batches:
            x = lifted(_matrix(b.column("e")), peak, top, query=True)
            at, tree, leaf_, block = [], [], [], []
            for i in range(len(x)):
                for t, one in search(forest, sizes, x[i], probes, 4 * (k + 1)):
                    for s in range(-(-int(sizes[t][one]) // GROUP)):
                        at.append(i), tree.append(t), leaf_.append(one), block.append(s)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf_, pa.int32()), pa.array(block, pa.int32()), *(b.column(c).take(take) for c in ("k0", "k1", "e"))], ["tree", "leaf", "block", "k0", "k1", "e"])

    asked = distinct.where("asks").select("k0", "k1", "e").mapInArrow(ask, f"tree int, leaf int, block int, k0 long, k1 long, e {e_type}").withColumn("part", F.pmod("k1", F.lit(parts)).cast("int"))
    per_leaf = F.element_at(F.element_at(F.lit([[max(1, -(-int(s) // GROUP)) for s in one] for one in sizes]), F.col("tree") + 1), F.col("leaf") + 1) if max(s.max() for s in sizes) > GROUP else F.lit(1)
    here = indexed.withColumn("block", F.pmod(F.col("k1"), per_leaf).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["q0", "q1", "k0", "k1", "least", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype="float64" if c == "score" else "int64") for c in names})
        a, b = np.stack(left["e"].to_numpy()).astype(np.float64), np.stack(right["e"].to_numpy()).astype(np.float64)
        # as many distinct vectors as can be in an answer, besides the query's own
        i, j, score = best_pairs(a, b, right["least"].to_numpy(), k + 1)
        return pd.DataFrame(dict(zip(names, (left["k0"].to_numpy()[i], left["k1"].to_numpy()[i], right["k0"].to_numpy()[j], right["k1"].to_numpy()[j], right["least"].to_numpy()[j], score), strict=True)))

    group = ["tree", "leaf", "block", "part"]
    scored = asked.groupBy(*group).cogroup(here.groupBy(*group)).applyInPandas(meet, "q0 long, q1 long, k0 long, k1 long, least long, score double")
    best = Window.partitionBy("q0", "q1").orderBy(F.desc("score"), "least", "k0", "k1")
    once = scored.groupBy("q0", "q1", "k0", "k1").agg(F.min("least").alias("least"), F.max("score").alias("score"))
    top_vectors = durable(once.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1), "nearest_vectors")

    by_score = Window.partitionBy("q0", "q1").orderBy(F.desc("score"), "vec_id")
    named = top_vectors.join(kept.hint("merge"), ["k0", "k1"]).select("q0", "q1", "score", F.explode("ids").alias("vec_id"))
    named = named.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= k + 1).drop("at")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("k0").alias("q0"), F.col("k1").alias("q1")).distinct()
    answers = queries.join(named.hint("merge"), ["q0", "q1"]).where("vec_id != query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
