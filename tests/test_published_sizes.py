import pytest

from tidepanel.operators import models
from tidepanel.plans import baseline_run, model_queries, training
from tidepanel.plans.inputs import Dataset
from tidepanel.plans.registry import REGISTRY

RUN = ["model_comparison", "baseline_run", "baseline_run_threshold_rows", "baseline_run_threshold_errors", "model_error_breakdown", "model_error_rates", "shortcut_audit", "forest_importances", "forecast_comparison"]
CALIBRATED = [
    "calibration_comparison", "calibration_leakage_checks", "model_metadata", "attribution_faithfulness", "global_attribution", "local_explanations",
    "representative_rows", "recommendations_with_model", "risk_assessment_with_model", "scenario_scores_with_model", "incidents_with_model", "context_export",
]


class Asked(Exception):
    pass


class Fresh:
    """A run that has stored nothing yet."""

    root = "nowhere"

    def __init__(self, *_):
        pass

    def complete(self, name):
        return False

    def stage(self, name, make):
        return make()

    def place(self, name, save):
        return save(name)


@pytest.mark.parametrize("name", RUN + CALIBRATED)
def test_registered_queries_train_the_published_sizes(monkeypatch, name):
    def fit(*args, **sizes):
        raise Asked([x for x in args if isinstance(x, dict)])

    monkeypatch.setattr(Dataset, "store", lambda self, *_: self)
    for place in (baseline_run, model_queries):
        monkeypatch.setattr(place, "StagedRun", Fresh)
    for place in (training, model_queries):
        monkeypatch.setattr(place, "model_frame", lambda *_: None)
    monkeypatch.setattr(baseline_run, "role", lambda *_: None)
    for place, f in [(training, "fit_all"), (training, "forecasts"), (model_queries, "calibrated_forest")]:
        monkeypatch.setattr(place, f, fit)
    with pytest.raises(Asked) as asked:
        REGISTRY[name](None, "")
    forest, *boosting = asked.value.args[0]
    assert (forest["numTrees"], forest["maxDepth"]) == (300, 6)
    assert all((b["maxIter"], b["maxDepth"]) == (300, 4) for b in boosting)
    assert models.FOREST["minInstancesPerNode"] == 20
