"""Scores and importances of trained models recomputed by plain loops over their trees."""

import math

import pytest

from tallyfold.operators import models


@pytest.fixture(scope="module")
def trained(spark):
    rows = spark.range(600).selectExpr("id", "CAST(id % 3 = 0 OR id % 7 = 1 AS int) AS label", "CAST(id % 3 AS double) + id % 5 AS f_amount", "CAST(id % 7 AS double) AS f_other", "CAST(id * id % 11 AS double) AS f_noise")
    rows = rows.repartition(3).cache()
    return rows, models.train(rows, trees=7, depth=4, rounds=6)


def leaf(node, values):
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if values[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node


def stats(node):
    return list(node.impurityStats().stats())


def test_scores_follow_from_the_trees(trained):
    rows, fitted = trained
    forest, boosted = ([t._java_obj for t in fitted[n].trees] for n in (models.FOREST, models.BOOSTED))
    weights = list(fitted[models.BOOSTED].treeWeights)
    got = {r.id: r for r in models.score(rows, fitted).collect()}
    assert len(got) == 600 and len({r.model_name for r in got.values()}) == 2
    for r in rows.where("id < 200").collect():
        values = [r.f_amount, r.f_other, r.f_noise]
        votes = [stats(leaf(t.rootNode(), values)) for t in forest]
        share = sum(v[1] / sum(v) for v in votes) / len(votes)
        margin = sum(w * leaf(t.rootNode(), values).prediction() for w, t in zip(weights, boosted, strict=True))
        boost = 1 / (1 + math.exp(-2 * margin))
        assert got[r.id].risk_score == pytest.approx(max(share, boost), abs=1e-9)
        assert got[r.id].model_name == (models.FOREST if share >= boost else models.BOOSTED)


def gains(node, found):
    """The gain of each split times its rows, by feature."""
    if node.getClass().getSimpleName() == "InternalNode":
        k = node.split().featureIndex()
        found[k] = found.get(k, 0.0) + node.gain() * node.impurityStats().count()
        gains(node.leftChild(), found)
        gains(node.rightChild(), found)
    return found


def test_importances_follow_from_the_trees(spark, trained):
    _, fitted = trained
    names = ["f_amount", "f_other", "f_noise"]
    got = {(r.model_name, r.feature): r.importance for r in models.importances(fitted, names, spark).collect()}
    for name, per_tree in ((models.FOREST, True), (models.BOOSTED, False)):
        total = [0.0] * 3
        for t in fitted[name].trees:
            own = gains(t._java_obj.rootNode(), {})
            whole = sum(own.values()) or 1.0
            for k, g in own.items():
                total[k] += g / whole if per_tree else g
        for k, n in enumerate(names):
            assert got[name, n.removeprefix("f_")] == pytest.approx(total[k] / sum(total), abs=1e-9)
