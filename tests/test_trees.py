"""Histogram trees: both ways of growing agree, and equal a plain search over all splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import trees
from tidepanel.operators.trees import BOOSTING, CLASSES, VALUES, Plan

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(900).select(
        "id", (F.col("id") % 2 + 7).alias("horizon"), *[F.round(F.rand(i + 1), 2).alias(c) for i, c in enumerate(COLUMNS)], F.rand(9).alias("noise")
    )
    rows = rows.withColumn("y", (F.col("a") + F.col("b") * F.col("c") + 0.3 * F.col("noise") > 0.8).cast("int"))
    return rows.withColumn("amount", F.exp(3 * F.col("a")) * F.col("b")).cache()


PLANS = [
    (Plan(CLASSES, 4, 3, bins=16, least_rows=10, features=2), "y"),
    (Plan(VALUES, 3, 3, bins=16, least_rows=10), "amount"),
    (Plan(BOOSTING, 5, 2, bins=16, features=3), "y"),
]


def fit(frame, columns, target, plan, keys, model=None, **how):
    scale = trees.FIXED_POINT if plan.kind == VALUES else 1.0
    return trees.fit(trees.prepare(frame, columns, target, keys, model, plan.bins, scale), plan, **how)


def same(x, y):
    return all(np.array_equal(getattr(x.trees, f), getattr(y.trees, f)) for f in ("feature", "cut", "size", "target"))


@pytest.mark.parametrize("plan,target", PLANS)
def test_both_ways_grow_the_same_trees(frame, plan, target, monkeypatch):
    monkeypatch.setattr(trees, "MARGIN_ROUNDS", 2)
    here = fit(frame, COLUMNS, target, plan, ["id"], "horizon")
    there = fit(frame.repartition(7), COLUMNS, target, plan, ["id"], "horizon", most_bytes=0)
    assert set(here) == set(there) == {7, 8}
    for m in here:
        if [e.tolist() for e in here[m].edges] == [e.tolist() for e in there[m].edges]:  # approximate cut points
            assert same(here[m], there[m])
    alone = fit(frame.where("horizon = 7"), COLUMNS, target, plan, ["id"], "horizon")
    assert (alone[7].trees.feature[:, 0] >= 0).all()


def plain_tree(plan, bins, a, b, chosen_of, root, node=0, level=0):
    """Split by trying every candidate and cut over the rows themselves."""
    out = {}
    whole = a.sum(), b.sum()
    best = (1e-9, None)

    def worth(x, y):
        if plan.kind == BOOSTING:
            return (y / trees.FIXED_POINT) ** 2 / (x / trees.FIXED_POINT + plan.penalty)
        if plan.kind == VALUES:
            return (y / trees.FIXED_POINT) ** 2 / x
        up, down = root[0] / (2 * root[1]), root[0] / (2 * (root[0] - root[1]))
        p, n = up * y, down * (x - y)
        return (p * p + n * n) / (p + n)

    if level < plan.depth:
        for f in chosen_of(node):
            for cut in range(plan.bins - 1):
                left = bins[:, f] <= cut
                la, ra = a[left].sum(), a[~left].sum()
                least = plan.least_weight * trees.FIXED_POINT if plan.kind == BOOSTING else plan.least_rows
                if min(la, ra) < least:
                    continue
                gain = worth(la, b[left].sum()) + worth(ra, b[~left].sum()) - worth(*whole)
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut))
    out[node] = (best[1], whole)
    if best[1]:
        left = bins[:, best[1][0]] <= best[1][1]
        for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
            out |= plain_tree(plan, bins[side], a[side], b[side], chosen_of, root, child, level + 1)
    return out


@pytest.mark.parametrize("plan,target", PLANS)
def test_trees_equal_a_plain_search(frame, plan, target):
    model = fit(frame.where("horizon = 7"), COLUMNS, target, plan, ["id"])[0]
    scale = trees.FIXED_POINT if plan.kind == VALUES else 1.0
    rows = trees.binned(frame.where("horizon = 7").withColumn("_model", F.lit(0)), COLUMNS, target, ["id"], model.edges, scale).toPandas()
    bins, keys, y = trees._arrays(rows, len(COLUMNS))
    weight = (y == 0).sum() / y.sum() if plan.kind == BOOSTING else 1.0
    margin = np.zeros(len(y))
    for t in range(plan.trees):
        drawn, a, b = trees.drawn_rows(plan, 0, t, keys, y, margin, weight)
        chosen_of = lambda n: trees.candidates(plan, len(COLUMNS), 0, t, [n])[0]  # noqa: B023,E731
        want = plain_tree(plan, bins[drawn], a, b, chosen_of, (a.sum(), b.sum()))
        for node, (split, whole) in want.items():
            assert (model.trees.size[t, node], model.trees.target[t, node]) == whole
            found = int(model.trees.feature[t, node])
            assert split == ((found, int(model.trees.cut[t, node])) if found >= 0 else None)
        margin += trees.node_values(plan, model.trees, t)[model.trees.node_of(t, bins)]


def test_draws_hang_on_the_row_alone():
    keys = np.arange(20_000)
    plan = PLANS[0][0]
    drawn = trees.bootstrap(keys, plan, 7, 0)
    assert np.array_equal(drawn[::3], trees.bootstrap(keys[::3].copy(), plan, 7, 0))
    assert abs(drawn.mean() - 1) < 0.03 and abs((drawn == 0).mean() - np.exp(-1)) < 0.02
    assert (drawn != trees.bootstrap(keys, plan, 7, 1)).any()


def test_scores_separate_and_importances_sum_to_one(frame):
    for plan, target in PLANS:
        model = fit(frame, COLUMNS, target, Plan(plan.kind, 30, 4, bins=32, features=plan.features, rate=0.2), ["id"])[0]
        scored = model.score(frame, "s")
        assert scored.corr("s", target) > 0.6
        assert model.importances().sum() == pytest.approx(1) and model.importances().argmax() in (0, 1)


def test_awkward_values(spark):
    rows = spark.createDataFrame([(i, float("nan") if i % 5 == 0 else float(i), 1.0, i % 2) for i in range(60)], "id long, a double, b double, y int")
    model = fit(rows, ["a", "b"], "y", Plan(CLASSES, 2, 2, least_rows=5), ["id"])[0]
    assert (model.trees.feature != 1).all()  # a constant never splits
    assert model.score(rows, "s").where("s between 0 and 1").count() == 60
    one_class = fit(rows.withColumn("y", F.lit(0)), ["a", "b"], "y", Plan(CLASSES, 2, 2), ["id"])[0]
    assert one_class.score(rows, "s").agg(F.max("s")).first()[0] == 0


def test_rows_without_target_are_left_out(spark):
    rows = spark.createDataFrame([(i, float(i) if i % 7 else None, None if i % 5 == 0 else i % 2) for i in range(60)], "id long, a double, y int")
    model = fit(rows, ["a"], "y", Plan(CLASSES, 2, 2, least_rows=5), ["id"])[0]
    assert model.score(rows, "s").where("s between 0 and 1").count() == 60
    assert trees.prepare(rows.limit(0), ["a"], "y", ["id"]).counts == {}
    assert trees.fit(trees.prepare(rows.limit(0), ["a"], "y", ["id"]), PLANS[0][0]) == {}
