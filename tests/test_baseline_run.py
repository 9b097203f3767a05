"""The full run at small sizes: complete, resumable, and its baseline rows are the baseline's own."""

import pytest
from pyspark.sql import functions as F

from tidepanel.plans import training
from tidepanel.plans.baseline_run import BaselineRun
from tidepanel.plans.inputs import Dataset
from tidepanel.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
SMALL = dict(numTrees=3, maxDepth=2), dict(maxIter=2, maxDepth=2)


@pytest.fixture(scope="module")
def report(spark):
    return BaselineRun(Dataset(spark, SF), *SMALL).report().cache()


def test_every_model_has_every_section(report):
    found = {(r.section, r.model, r.horizon_days) for r in report.select("section", "model", "horizon_days").distinct().collect()}
    models = {training.BASELINE, "logistic_regression", "random_forest", "gradient_boosting"}
    for section in ("comparison", "cost", "reliability", "error_breakdown", "error_rates"):
        assert {(m, h) for s, m, h in found if s == section} == {(m, h) for m in models for h in (7, 14, 30)}
    assert {(m, h) for s, m, h in found if s == "forecast"} == {(m, h) for m in ("naive", "random_forest") for h in (7, 14, 30)}


def test_a_second_run_fits_nothing(spark, report, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("fitted again")

    for name in ("fit_all", "model_frame", "forecasts", "compare"):
        monkeypatch.setattr(training, name, refuse)
    assert BaselineRun(Dataset(spark, SF), *SMALL).report().count() == report.count()


def test_baseline_rows_equal_its_own_evaluation(spark, report):
    own = {r.horizon_days: r for r in REGISTRY["threshold_comparison_table"](spark, SF).collect()}
    rows = report.where((F.col("section") == "comparison") & (F.col("model") == training.BASELINE)).collect()
    assert rows
    for r in rows:
        if r.item in own[r.horizon_days].asDict():
            assert r.value == pytest.approx(own[r.horizon_days][r.item], abs=1e-6), r.item
