import numpy as np
from pyspark.sql import functions as F

from pixelweft.llm import ann, queries


def exact(ids, x, asks, k=20):
    s = x @ x.T
    out = {}
    for i in asks:
        order = [j for j in np.lexsort((ids, -s[i])) if ids[j] != ids[i]][:k]
        out[ids[i]] = [int(ids[j]) for j in order]
    return out


def test_recall(spark):
    d = "/root/testdata/sf0.001"
    p = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    want = exact(ids, x, np.flatnonzero(ids % 20 == 0))
    got = queries.op3_neighbours(spark, d).toPandas()
    hits = [len(set(want[q]) & set(g.vec_id)) / len(want[q]) for q, g in got.groupby("query_id")]
    assert len(hits) == len(want) and np.mean(hits) >= 0.9
    at = {v: i for i, v in enumerate(ids)}
    assert np.allclose(got.score, [x[at[q]] @ x[at[v]] for q, v in zip(got.query_id, got.vec_id, strict=True)])
    assert all(g.sort_values("rank").score.is_monotonic_decreasing and list(g.sort_values("rank")["rank"]) == list(range(1, len(g) + 1)) for _, g in got.groupby("query_id"))


def test_forest_of_small_leaves(spark):
    """Many leaves and probes: recall against brute force, with norms that differ."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)) * rng.uniform(0.5, 2, (600, 1))
    v = spark.createDataFrame([(i, [float(f) for f in row], "extra") for i, row in enumerate(x)], "vec_id long, embedding array<float>, score string")
    x = np.stack(v.toPandas().embedding).astype(float)
    got = ann.nearest(v, F.col("vec_id") % 20 == 0, trees=8, leaf=16, probes=60).toPandas()
    want = exact(np.arange(600), x, range(0, 600, 20))
    assert np.mean([len(set(want[q]) & set(g.vec_id)) / 20 for q, g in got.groupby("query_id")]) >= 0.9


def test_awkward_vectors(spark):
    """Copies, ties, nulls, zeros, non-finite and short vectors."""
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.5, 0.5]) for i in range(3)]
    rows += [(20 * 50, None), (1020, [0.0, 0.0]), (1040, [float("nan"), 1.0]), (1060, [None, 1.0]), (1080, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(v, F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == {0, 20, 40, 100}
    assert [int(i) for i in got[got.query_id == 0].sort_values("rank").vec_id] == list(range(1, 21))
    assert [int(i) for i in got[got.query_id == 20].sort_values("rank").vec_id] == [i for i in range(22) if i != 20][:20]
    few = ann.nearest(v.where("vec_id in (0, 1, 100)"), F.col("vec_id") % 20 == 0).toPandas()
    assert len(few) == 4
    assert ann.nearest(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_ties(spark):
    """All vectors of eight components +1 or -1, ids in random order: nearly all scores are shared by many, and the smaller ids are the answer."""
    rng = np.random.default_rng(4)
    x = np.array([[1.0 if i >> b & 1 else -1.0 for b in range(8)] for i in range(256)])
    ids = rng.permutation(256)
    v = spark.createDataFrame([(int(i), [float(f) for f in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = ann.nearest(v, F.col("vec_id") % 20 == 0).toPandas()
    want = exact(ids, x, [int(np.flatnonzero(ids == q)[0]) for q in range(0, 256, 20)])
    assert {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")} == {int(q): w for q, w in want.items()}


def test_tiny_and_huge_components(spark):
    """Squares that vanish or overflow don't drop a vector."""
    rows = [(0, [1e-170, 0.0]), (1, [2e-170, 0.0]), (2, [0.0, 1e-300]), (3, [-1e-170, 1e-170])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, F.col("vec_id") == 0).toPandas()
    assert sorted(got.vec_id) == [1, 2, 3]
    big = spark.createDataFrame([(i, [1e160 * (1 + i % 7), 1e-200 * i, 3.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = ann.nearest(big, F.col("vec_id") % 20 == 0, trees=4, leaf=16, probes=400).toPandas()
    assert got.groupby("query_id").size().eq(20).all() and np.isfinite(got[["rank", "vec_id"]]).all().all()
