"""Evaluation against separate tables, several settings in one pass, and attributions against a game over all coalitions."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from pixelweft.operators import change, evaluation, explain, features, priority
from pixelweft.schemas import FEATURE_NAMES
from pixelweft.sources import sinks
from tests.test_operators import block_pixels


def tables(spark, scored):
    """Rows (sample, row, col, prob, target, valid) as three tables; a missing value of the last three is a missing row for the marker 'no'."""
    cells = [(r[0], r[1], r[2]) for r in scored]
    keep = lambda n, kind: spark.createDataFrame([(*c, r[n]) for c, r in zip(cells, scored, strict=True) if r[n] != "no"], f"sample string, row int, col int, {kind}")
    return keep(3, "prob double"), keep(4, "target int"), keep(5, "valid boolean")


def test_vectors(spark):
    rows = [("perfect", 0, i, p, t, True) for i, (p, t) in enumerate(zip((0.9, 0.1, 0.8, 0.2), (1, 0, 1, 0), strict=True))]
    rows += [("empty", r, c, 0.0, 0, True) for r in range(4) for c in range(4)]
    rows += [("masked", 0, 0, 0.9, 1, True), ("masked", 0, 1, 0.1, 0, True), ("masked", 0, 2, 0.9, 0, False), ("masked", 0, 3, float("nan"), 1, True), ("masked", 0, 4, None, 1, True), ("masked", 0, 5, 0.9, None, True), ("masked", 0, 6, 0.9, 1, None)]
    rows += [("mixed", 0, 0, 0.9, 1, True), ("mixed", 0, 1, 0.9, 0, True), ("mixed", 0, 2, 0.45, 1, True)]
    rows += [("gaps", 0, 0, 0.9, "no", True), ("gaps", 0, 1, 0.9, 1, "no"), ("gaps", 0, 2, "no", 1, True), ("gaps", 0, 3, 0.9, 1, True), ("unseen", 0, 0, "no", 1, True)]
    got = {r["sample"]: r for r in evaluation.evaluate(*tables(spark, rows)).collect()}
    p = got["perfect"]
    assert (p["precision"], p["recall"], p["f1"], p["iou"], p["accuracy"]) == (1, 1, 1, 1, 1)
    assert (got["empty"]["accuracy"], got["empty"]["f1"], got["empty"]["iou"]) == (1.0, 0.0, 0.0)
    m = got["masked"]
    assert (m["tp"], m["tn"], m["fp"], m["fn"], m["total_pixels"], m["valid_pixels"], m["masked_pixels"]) == (1, 1, 0, 0, 7, 2, 5)
    x = got["mixed"]
    assert (x["tp"], x["fp"], x["fn"], x["precision"], x["recall"], x["f1"], x["iou"]) == (1, 1, 1, 0.5, 0.5, 0.5, round(1 / 3, 6))
    g = got["gaps"]
    assert (g["tp"], g["total_pixels"], g["valid_pixels"], g["no_truth"], g["no_validity"], g["no_prediction"]) == (1, 3, 1, 1, 1, 1)
    assert (got["unseen"]["total_pixels"], got["unseen"]["no_prediction"], got["unseen"]["iou"]) == (0, 1, 0.0)
    lower = {r["sample"]: r for r in evaluation.evaluate(*tables(spark, rows), threshold=0.4).collect()}["mixed"]
    assert (lower["tp"], lower["fn"]) == (2, 0)
    pred, truth, valid = tables(spark, rows)
    whole = evaluation.overall(evaluation.evaluate(pred, truth, valid)).first()
    assert whole["samples"] == 6 and whole["tp"] == sum(r["tp"] for r in got.values()) and whole["total_pixels"] == pred.count()
    assert evaluation.overall(evaluation.evaluate(pred.limit(0), truth.limit(0))).first()["accuracy"] == 0.0
    assert {r["sample"]: r["valid_pixels"] for r in evaluation.evaluate(pred, truth).collect()}["masked"] == 4


def test_bucketed_tables_meet_without_exchange(spark):
    keys = list(evaluation.CELL)
    cells = spark.range(300).selectExpr("cast(id % 3 as string) as sample", "cast(id div 30 as int) as row", "cast(id as int) as col", "id / 300.0D as prob", "cast(id % 2 as int) as target", "id % 5 != 0 as valid")
    three = [sinks.bucketed(cells.select(*keys, c), c, keys, 4) for c in ("prob", "target", "valid")]
    plan = evaluation.cells(*three)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    a, b = evaluation.evaluate(*three), evaluation.evaluate(cells.select(*keys, "prob"), cells.select(*keys, "target"), cells.select(*keys, "valid"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_settings_in_one_pass(spark):
    """Scores as columns are those of the fitted models, and one pass counts like one pass for each."""
    px = block_pixels(spark, 24, 5, 13).withColumn("target", F.col("change").cast("int"))
    px = px.withColumns({c: F.when((F.col("row") == 0) & (F.col("col") < 3), None).otherwise(F.col(c)) for c in ("b_b02",)})
    models = change.fit_scorers(px, [{"reg": 0.1}, {"reg": 0.001, "max_iter": 5}])
    x, _ = change.pixel_inputs(px)
    for m in models:
        both = change.score(px, m).select("row", "col", "change_prob").join(x.select("row", "col", change.linear_score(m).alias("p")), ["row", "col"])
        assert both.where("(change_prob is null) != (p is null) or abs(change_prob - p) > 1e-12").count() == 0
    together = {r["setting"]: r for r in evaluation.compared(x, {str(i): change.linear_score(m) for i, m in enumerate(models)}).collect()}
    for i, m in enumerate(models):
        alone = change.confusion(change.with_mask(change.score(px, m)), []).first()
        assert all(together[str(i)][k] == alone[k] for k in ("tp", "fp", "fn", "tn", "precision", "iou"))


def vectors(spark, n):
    rng = np.random.default_rng(2)
    x = rng.random((n, len(FEATURE_NAMES))) * 10
    y = (x[:, 3] + x[:, 7] > 12).astype(int) + (x[:, 11] > 7)
    return spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))], "k int, " + ", ".join(f"{f} double" for f in FEATURE_NAMES) + ", priority_int int"), x


def test_attributions_against_all_coalitions(spark):
    """Shapley values by their definition: what each feature adds to every set of the others, in a forest whose unknown features follow the training weights."""
    rows, x = vectors(spark, 120)
    model = priority.fit(rows, trees=3, depth=3)
    trees = model.stages[-1].trees
    used = sorted({int(f) for t in trees for f in np.flatnonzero(t.featureImportances.toArray())})
    assert 3 <= len(used) <= 12

    def read(node):
        """(shares, weight) of a leaf, or (feature, threshold, left, right, weight)."""
        stats = np.array(list(node.impurityStats().stats()))
        if node.numDescendants() == 0:
            return stats / stats.sum(), stats.sum()
        return node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild()), stats.sum()

    def worth(node, known, row):
        if len(node) == 2:
            return node[0]
        f, cut, left, right, _ = node
        if f in known:
            return worth(left if row[f] <= cut else right, known, row)
        return (left[-1] * worth(left, known, row) + right[-1] * worth(right, known, row)) / (left[-1] + right[-1])

    roots = [read(t._call_java("rootNode")) for t in trees]
    whole = lambda known, row: sum(worth(r, known, row) for r in roots) / len(roots)
    phi, base = explain.attribute(x[:4], explain.leaves(model))
    assert np.allclose(base, whole(set(), x[0]))
    n = len(used)
    for i in range(4):
        value = {s: whole(set(s), x[i]) for k in range(n + 1) for s in itertools.combinations(used, k)}
        for f in used:
            rest = [u for u in used if u != f]
            want = sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value[tuple(sorted((*s, f)))] - value[s]) for k in range(n) for s in itertools.combinations(rest, k))
            assert np.allclose(phi[i, f], want, atol=1e-9)
        assert np.allclose(phi[i].sum(0) + base, value[tuple(used)]) and np.allclose(np.delete(phi[i], used, 0), 0)


def test_importances_are_ordered(spark):
    rows, _ = vectors(spark, 120)
    model = priority.fit(rows, trees=5, depth=3)
    got = [(r["feature"], r["importance"]) for r in priority.importances(model).collect()]
    values = model.stages[-1].featureImportances.toArray()
    assert dict(got) == dict(zip(FEATURE_NAMES, map(float, values), strict=True)) and [v for _, v in got] == sorted(values, reverse=True) and got[0][0] in {FEATURE_NAMES[i] for i in (3, 7, 11)}


def test_assessment_of_rows_that_the_model_has_not_seen(spark):
    rows, _ = vectors(spark, 400)
    model = priority.fit(rows.where("k % 4 != 0"), trees=20)
    held = rows.where("k % 4 = 0")
    scored = priority.scored(held, model)
    assert scored.where("predicted_int = priority_int").count() > 0.6 * held.count()
    assert scored.where("abs(aggregate(probs, 0D, (s, p) -> s + p) - 1) > 1e-9").count() == 0
    x = features.rule_label(features.vector(features.extract(block_pixels(spark, 40, 10, 20)), ["scene_id"]))
    assert explain.assess(x, model, ["scene_id"]).count() == 1
    summed = explain.attributions(scored, model, ["k"]).groupBy("k", "class_int").agg((F.sum("shap_value") + F.first("base")).alias("p"))
    both = summed.join(scored.select("k", "probs"), "k").where("abs(p - probs[class_int]) > 1e-9")
    assert both.count() == 0
