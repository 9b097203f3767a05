import time
from itertools import combinations
from math import factorial

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import attribution, models
from tidepanel.operators.metrics import LABEL
from tidepanel.operators.trees import node_values, node_weights

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = spark.range(600).select(
        F.col("id"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"), F.rand(4).alias("noise")
    )
    return rows.withColumn(LABEL, (F.col("a") + F.col("b") * F.col("c") + F.col("noise") > 1.3).cast("int")).cache()


@pytest.fixture(scope="module")
def forest(frame):
    return models.fit_forest(frame, COLUMNS, numTrees=4, maxDepth=4)


def _tree_value(model, t, node, x, known):
    """Expected leaf value with only the known features fixed, by walking the tree."""
    feature = int(model.trees.feature[t, node])
    if feature < 0:
        return node_values(model.plan, model.trees, t)[node]
    left, right = 2 * node + 1, 2 * node + 2
    if feature in known:
        return _tree_value(model, t, left if x[feature] <= model.edges[feature][model.trees.cut[t, node]] else right, x, known)
    weight = node_weights(model.plan, model.trees, t)
    share = weight[left] / weight[node]
    return share * _tree_value(model, t, left, x, known) + (1 - share) * _tree_value(model, t, right, x, known)


def test_attribution_is_additive_and_equals_brute_force(spark, frame, forest):
    scored = models.predict(forest, frame, "probability_raw")
    explainer = attribution.build_explainer(forest, COLUMNS, spark)
    attributed = attribution.attribute(scored, explainer, ["id", "probability_raw", *COLUMNS]).cache()
    check = attribution.faithfulness(attributed).first()
    assert check["faithful"] and check["max_abs_reconstruction_error"] < 1e-9 and check["n_rows"] == 600

    d = len(COLUMNS)
    for row in attributed.orderBy("id").limit(5).collect():
        x = [row[c] for c in COLUMNS]
        value = lambda known: sum(_tree_value(forest, t, 0, x, known) for t in range(4)) / 4  # noqa: B023
        for j in range(d):
            others = [i for i in range(d) if i != j]
            want = sum(
                factorial(k) * factorial(d - 1 - k) / factorial(d) * (value({*s, j}) - value(set(s)))
                for k in range(d)
                for s in combinations(others, k)
            )
            assert row["contributions"][j] == pytest.approx(want, abs=1e-9)

    explained = attribution.drivers(attributed, COLUMNS, top_k=2).first()
    sizes = [abs(c["phi"]) for c in explained["all_contributors"]]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 3
    assert all(c["direction"] == "increases_risk" for c in explained["top_positive"])


def test_unfaithful_attribution_is_refused(spark, frame, forest):
    explainer = attribution.build_explainer(forest, COLUMNS, spark)
    explainer.base_value += 0.01
    attributed = attribution.attribute(models.predict(forest, frame, "probability_raw"), explainer, ["id", "probability_raw"])
    with pytest.raises(ValueError):
        attribution.assert_faithful(attributed)


def test_platt_preserves_ranking_and_centres_the_mean(frame, forest):
    scored = models.predict(forest, frame, "probability")
    platt = models.fit_platt(scored)
    both = scored.withColumn("p", platt.apply(F.col("probability"))).select("probability", "p", LABEL).toPandas()
    assert platt.slope > 0 and both["p"].between(0, 1).all()
    assert both.sort_values("probability")["p"].is_monotonic_increasing
    assert both["p"].mean() == pytest.approx(both[LABEL].mean(), abs=0.01)


@pytest.mark.parametrize("fit", [models.fit_logistic, lambda f, c: models.fit_boosting(f, c, maxIter=3, maxDepth=2)])
def test_other_models_score_in_the_unit_interval(frame, fit):
    got = models.predict(fit(frame, COLUMNS), frame).agg(F.min("probability").alias("lo"), F.max("probability").alias("hi")).first()
    assert 0 <= got["lo"] < got["hi"] <= 1


def test_forecast_is_back_on_the_amount_scale(frame):
    amounts = frame.withColumn("amount", F.col("a") * 1000)
    model = models.fit_regression_forest(amounts, COLUMNS, "amount", numTrees=4, maxDepth=4)
    error = models.predict_amount(model, amounts).agg(F.avg(F.abs(F.col("forecast") - F.col("amount")))).first()[0]
    assert error < 150


def test_forbidden_columns_cannot_be_trained_on(frame):
    with pytest.raises(ValueError):
        models.fit_forest(frame.withColumn("baseline_rate", F.col("a")), ["baseline_rate"])


def test_artifact_round_trip_and_refusals(spark, frame, forest, tmp_path):
    artifact = models.Artifact(forest, models.PlattScaling(2.0, -1.0), 30, 0.5, COLUMNS, fingerprints={"t": "ff"})
    path = str(tmp_path / "artifact")
    models.save_artifact(artifact, path, spark)
    loaded = models.load_artifact(path, spark, 30, 3)
    a, b = (x.score(frame).select("id", "probability_raw", "probability").orderBy("id").collect() for x in (artifact, loaded))
    assert a == b and loaded.metadata(spark).first()["n_features"] == 3
    with pytest.raises(ValueError):
        models.load_artifact(path, spark, 7, 3)
    with pytest.raises(ValueError):
        models.load_artifact(path, spark, 30, 55)
    assert [r["rank"] for r in models.importances(forest, COLUMNS, "f", spark).collect()] == [1, 2, 3]


def test_leaf_tables_at_the_published_size_are_quick(spark, frame):
    forest = models.fit_forest(frame, COLUMNS, minInstancesPerNode=2)
    begun = time.time()
    explainer = attribution.build_explainer(forest, COLUMNS, spark)
    assert len(explainer.trees) == 300 and time.time() - begun < 20
    scored = models.predict(forest, frame, "probability_raw")
    assert attribution.faithfulness(attribution.attribute(scored, explainer, ["id", "probability_raw"])).first()["max_abs_reconstruction_error"] < 1e-9
