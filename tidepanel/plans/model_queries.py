"""Trained models, calibration, attribution and the decisions that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import attribution, decisions, models, quality
from tidepanel.operators.features import feature_columns, manifest, manifest_df
from tidepanel.operators.metrics import LABEL
from tidepanel.plans.audit_queries import input_digests
from tidepanel.plans.context import context_documents
from tidepanel.plans.decision_queries import HORIZON, request_log
from tidepanel.plans.registry import query, rounded
from tidepanel.plans.baseline_run import BaselineRun
from tidepanel.plans.staged import StagedRun
from tidepanel.plans.training import BASELINE, BY, calibrated_forest, calibration_report, leakage_checks, model_frame, role

KEYS = ["merchant_id", "as_of_date", "day_index"]


COMPARED = ["precision", "recall", "f1", "pr_auc", "roc_auc", "brier_score", "stress_recall", "median_warning_lead_time_days", "n_episodes_total", "n_early_warning"]


@query("model_comparison")
def _(d):
    """The threshold baseline and three models at every horizon."""
    return rounded(BaselineRun(d).comparison)


@query("baseline_run")
def _(d):
    """Every report of the full run in long form."""
    return rounded(BaselineRun(d).report())


@query("baseline_run_threshold_rows")
def _(d):
    """The threshold baseline's rows of the full run, which must equal its own evaluation."""
    rows = BaselineRun(d).comparison.where(F.col("model") == BASELINE)
    return rounded(rows.select(*BY, *COMPARED))


@query("baseline_run_threshold_errors")
def _(d):
    rates = BaselineRun(d).error_rates.where(F.col("model") == BASELINE)
    return rounded(rates.drop("model"))


@query("model_error_breakdown")
def _(d):
    return BaselineRun(d).error_breakdown


@query("model_error_rates")
def _(d):
    return rounded(BaselineRun(d).error_rates)


@query("shortcut_audit")
def _(d):
    """Importance concentration, single-feature AUCs and column rules in one verdict per model and horizon."""
    return rounded(BaselineRun(d).shortcuts)


@query("forest_importances")
def _(d):
    return BaselineRun(d).importances.where(F.col("model") == "random_forest")


@query("forecast_comparison")
def _(d):
    """Naive persistence against a forest on log1p of the amount, at every horizon."""
    return rounded(BaselineRun(d).forecasts, 4)


def calibrated(d):
    """The frame, the calibrated forest and the validation halves at the published horizon, each made once per input state."""
    run = StagedRun(d.spark, d.sf_dir, f"{d.level}|{HORIZON}|{models.FOREST}")
    frame = run.stage("frame", lambda: model_frame(d, HORIZON))

    def save(path):
        artifact, halves = calibrated_forest(frame, models.FOREST)
        artifact.fingerprints = {r["table_name"]: r["digest"] for r in quality.merged_digests(input_digests(d)).collect()}
        models.save_artifact(artifact, f"{path}/artifact", d.spark)
        halves.write.parquet(f"{path}/halves")

    place = run.place("calibrated", save)
    artifact = models.load_artifact(f"{place}/artifact", d.spark, HORIZON, len(feature_columns()))
    return run, frame, artifact, d.spark.read.parquet(f"{place}/halves")


@query("calibration_comparison")
def _(d):
    """Forest before and after sigmoid scaling: metrics, cost and lead time on test and stress rows."""
    _, frame, artifact, halves = calibrated(d)
    return rounded(calibration_report(frame, artifact, halves))


@query("calibration_leakage_checks")
def _(d):
    """What would betray leakage into the calibration; every check must hold."""
    _, frame, artifact, halves = calibrated(d)
    return leakage_checks(frame, artifact, halves)


@query("model_metadata")
def _(d):
    """The stored artifact's description with one content digest per input table."""
    return calibrated(d)[2].metadata(d.spark)


def _explained(d, rows: str = "normal_test"):
    run, frame, artifact, _ = calibrated(d)

    def make():
        explainer = attribution.build_explainer(artifact.model, artifact.feature_columns, d.spark)
        return attribution.attribute(artifact.score(role(frame, rows)), explainer, [*KEYS, LABEL, "probability_raw", "probability", *artifact.feature_columns])

    return artifact, run.stage(f"attributed_{rows}", make)


@query("attribution_faithfulness")
def _(d):
    return rounded(attribution.faithfulness(_explained(d)[1]))


@query("global_attribution")
def _(d):
    artifact, attributed = _explained(d)
    ranking, _ = attribution.global_importance(attributed, artifact.feature_columns, manifest_df(d.spark))
    return ranking


@query("global_attribution_by_group")
def _(d):
    artifact, attributed = _explained(d)
    return attribution.global_importance(attributed, artifact.feature_columns, manifest_df(d.spark))[1]


@query("local_explanations")
def _(d):
    artifact, attributed = _explained(d)
    attribution.assert_faithful(attributed)
    explained = attribution.described(attribution.drivers(attributed, artifact.feature_columns), artifact.feature_columns, manifest())
    return explained.select(
        *KEYS,
        "probability",
        "probability_raw",
        decisions.risk_state(F.col("probability"), artifact.decision_threshold).alias("risk_state"),
        "base_value",
        "reconstructed",
        "top_positive",
        "top_negative",
    )


@query("representative_rows")
def _(d):
    artifact, attributed = _explained(d)
    return attribution.representative_rows(attributed, artifact.decision_threshold, LABEL, KEYS)


@query("recommendations_with_model")
def _(d):
    artifact, attributed = _explained(d)
    group_of = {row["name"]: row["group"] for row in manifest()}
    elevating = attribution.elevating_groups(attributed, artifact.feature_columns, group_of, KEYS).withColumnRenamed("as_of_date", "date").drop("day_index")
    test_days = attributed.select("merchant_id", F.col("as_of_date").alias("date"))
    scope = d.features.join(test_days, ["merchant_id", "date"], "left_semi")
    return rounded(decisions.recommendations(scope, elevating))


def _scored_days(d, run, artifact):
    """Every entity-day with raw and calibrated probability, scored once per input state."""
    return run.stage("scored_days", lambda: artifact.score(d.features).select("merchant_id", "date", "day_index", "probability_raw", "probability"))


@query("risk_assessment_with_model")
def _(d):
    """Risk of every entity-day from the trained artifact: raw and calibrated probability, exposure and stress."""
    d.store("daily")
    run, _, artifact, _ = calibrated(d)
    scored = _scored_days(d, run, artifact).join(decisions.exposure_estimate(d.daily, artifact.horizon_days).drop("day_index"), ["merchant_id", "date"])
    return rounded(
        scored.select(
            "merchant_id", "date", "day_index", "probability_raw", "probability",
            decisions.risk_state(F.col("probability"), artifact.decision_threshold).alias("risk_state"),
            "exposure",
            decisions.liquidity_stress(F.col("exposure"), F.col("available_liquidity")).alias("liquidity_stress"),
        )
    )


def _simulated(d, artifact):
    requests = decisions.validate_requests(request_log(d), d.features, d.dimension).where(F.col("error").isNull())
    exposure = decisions.exposure_estimate(d.daily, artifact.horizon_days)
    return decisions.simulate(requests, d.features, exposure, artifact.feature_columns, artifact.score, artifact.decision_threshold)


def _model_incidents(d, run, artifact):
    exposure = decisions.exposure_estimate(d.daily, artifact.horizon_days)
    return decisions.incidents(d.events, d.daily, d.dimension, _scored_days(d, run, artifact), artifact.decision_threshold, exposure, d.spark)


@query("scenario_scores_with_model")
def _(d):
    """Current and changed rows of every valid request, scored in one pass by the trained artifact."""
    d.store("daily", "features")
    return rounded(_simulated(d, calibrated(d)[2]))


@query("incidents_with_model")
def _(d):
    d.store("daily", "features", "events")
    run, _, artifact, _ = calibrated(d)
    return rounded(decisions.summarize_incidents(_model_incidents(d, run, artifact)))


@query("context_export")
def _(d):
    """One nested document per explained entity-day: risk, exposure, confidence, drivers, actions, simulation, incident."""
    artifact, attributed = _explained(d)
    run = calibrated(d)[0]
    d.store("daily", "features", "events")
    return context_documents(d, artifact, attributed, _simulated(d, artifact), _model_incidents(d, run, artifact))
