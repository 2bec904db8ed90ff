"""Bitmaps that come with the signatures of lines."""

import random

from pixelweft.llm import line_dedup


def test_bitmaps_rule_out_no_similar_pair(spark):
    """Every line has a bitmap from the pass that signs it, and no pair that is similar enough is ruled out, repeats or not."""
    r = random.Random(41)
    lines = []
    for n in (3, 40, 90, 400, 1500):
        for base in ("".join(r.choices("abcdefghij klmnop", k=n)), ("".join(r.choices("abcdef", k=9)) + " ") * (n // 9 + 1)):
            lines += [base] + [base[:i] + "#" + base[i + 1 :] for i in r.sample(range(len(base)), 3)] + ["".join(r.choices("abcdefghij klmnop", k=n))]
    sets = [{s[i : i + 5] for i in range(max(1, len(s) - 4))} for s in lines]
    signed = line_dedup._signatures(spark.createDataFrame(list(enumerate(lines)), "lid long, line string"), 5)
    assert signed.count() == len(lines)
    met = signed.alias("x").crossJoin(signed.alias("y")).where("x.lid < y.lid").where(line_dedup._near(0.8)).selectExpr("x.lid as a", "y.lid as b")
    near = {(p["a"], p["b"]) for p in met.collect()}
    similar = {(i, j) for j in range(len(lines)) for i in range(j) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert similar and similar <= near and len(near) < len(lines) * (len(lines) - 1) / 4
