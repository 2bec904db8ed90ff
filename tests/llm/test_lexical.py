"""Ranked search against the formula, written apart from it."""

import math
import re
from collections import Counter

import duckdb
import pytest

from pixelweft.llm import lexical, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = set()
    for item, own in wanted.items():
        found = []
        for d, b in bags:
            if not b:
                continue
            m = 50 + 50 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in own if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out |= {(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)}
    return out


def found(df):
    return {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}


def test_sql(spark):
    c = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    assert found(queries.op12_search(spark, d)) == set(c.execute(f"select item_id, rank, doc_id, score from ({queries.OP12_SQL})").fetchall())


@pytest.mark.parametrize("block, piece", [(lexical.BLOCK, lexical.PIECE), (24, 8)])
def test_awkward(spark, monkeypatch, block, piece):
    """Nulls, empty and long texts, ties, repeated rows and ids, overlapping terms, other scripts, extra columns; one block and many, pieces shorter than a term."""
    monkeypatch.setattr(lexical, "PIECE", piece)
    docs = [(1, "The the THE cat"), (1, "the the the cat"), (2, None), (3, ""), (4, "...!"), (5, "cat cats concat cat-cat"), (6, "É été É漢字 cat_9"), (None, "cat the"), (None, "cat the")]
    docs += [(10 + i, "tie tie") for i in range(5)] + [(100, "cat " * 5000 + "x" * 300), (99, "\x00the\x7fcat")]
    items = [(7, "cat the"), (7, "CATS"), (8, None), (9, ""), (None, "cat"), (10, "été É 9"), (11, "tie"), (12, "absent"), (13, "x" * 300), (14, "cat")]
    x = spark.createDataFrame([(d, t, "q", 1.0) for d, t in docs], "doc_id long, text string, rank string, score double")
    y = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    assert found(lexical.search(x, y, k=4, block=block)) == brute(docs, items, 4)
    assert lexical.search(x.limit(0), y).count() == 0 and lexical.search(x, y.limit(0)).count() == 0


def test_many_candidates():
    """The pool of candidates settles often, and ties at its edge stay right."""
    import numpy as np

    rng = np.random.default_rng(1)
    best = lexical.Best(3, 5)
    best.limit = 40
    scores = rng.integers(0, 6, (400, 3))
    for a in range(0, 400, 16):
        ids = np.arange(400 - a, 400 - a - len(scores[a : a + 16]), -1)
        best.offer(scores[a : a + 16], ids, np.zeros(len(ids), np.int64))
    rows = best.settle()
    for i in range(3):
        want = sorted((-s, 400 - n) for n, s in enumerate(scores[:, i]) if s > 0)[:5]
        assert [(-r[1], r[3]) for r in rows if r[0] == i] == want
