"""Whole training jobs: the model comparison and the calibrated forest artifact."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import episodes, metrics, models, quality, splits
from tidepanel.operators.features import feature_columns
from tidepanel.operators.frames import row_overlaps
from tidepanel.operators.labels import HORIZONS
from tidepanel.operators.metrics import LABEL
from tidepanel.plans.evaluation import BASELINE_SIGNAL, roles_frame
from tidepanel.plans.inputs import Dataset
from tidepanel.sources.storage import written

ID_COLUMNS = ["merchant_id", "archetype", "as_of_date", "day_index", "horizon_days", "frame_role", LABEL, "future_chargeback_amount", "baseline_daily_chargeback_amount_trailing"]
VOLUME = "transaction_count_level_28d"
#: What travels with a score: the row's identity and the volume that errors are broken down by.
SCORED = [*ID_COLUMNS, VOLUME]
BASELINE = "historical_threshold_baseline"
BY = ["model", "horizon_days"]


def model_frame(d: Dataset, horizons: int | Sequence[int] = HORIZONS) -> DataFrame:
    """All roles of one or more horizons with all features, written once: every fit reads it."""
    chosen = [horizons] if isinstance(horizons, int) else list(horizons)
    frame = roles_frame(d, feature_columns()).where(F.col("horizon_days").isin(chosen))
    return written(frame.select(*ID_COLUMNS, *feature_columns()), "frames")


def forecasts(frame: DataFrame, forest: dict) -> DataFrame:
    """Naive persistence against a forest on log1p of the amount, a row per model and horizon."""
    fitted = models.fit_regression_forests(role(frame, "train"), feature_columns(), "future_chargeback_amount", "horizon_days", **forest)
    test = role(frame, "normal_test")
    parts = [models.predict_amount(m, test.where(F.col("horizon_days") == h)) for h, m in fitted.items()]
    naive = F.col("baseline_daily_chargeback_amount_trailing") * F.col("horizon_days")
    values = reduce(DataFrame.unionByName, parts).select(
        "horizon_days", "future_chargeback_amount", naive.alias("naive"), F.col("forecast").alias("random_forest")
    )
    both = values.unpivot(["horizon_days", "future_chargeback_amount"], ["naive", "random_forest"], "model", "value")
    return metrics.regression_metrics(both, BY, "future_chargeback_amount", "value")


def ranked_importances(spark: SparkSession, fitted: dict[str, dict[int, models.Model]]) -> DataFrame:
    """(model, feature, importance, rank, horizon_days) of the tree models."""
    parts = [
        models.importances(m, feature_columns(), name, spark).withColumn("horizon_days", F.lit(h))
        for name, by_horizon in fitted.items()
        for h, m in by_horizon.items()
        if hasattr(m, "importances")
    ]
    return reduce(DataFrame.unionByName, parts)


def shortcut_verdicts(spark: SparkSession, train: DataFrame, importances: DataFrame) -> DataFrame:
    """Importance concentration, single-feature AUCs and column rules in one verdict per model and horizon."""
    concentration = metrics.importance_concentration(importances, ["horizon_days", "model"])
    long = quality.long_form(train, ["horizon_days", LABEL], feature_columns(), "feature")
    suspicious = metrics.single_feature_audit(long, ["horizon_days"]).groupBy("horizon_days").agg(F.max("suspicious").alias("any_suspicious_feature"))
    names = spark.createDataFrame([(c,) for c in feature_columns()], "column_name string")
    violation = quality.column_audit(names).agg(F.max("violation")).scalar()
    return concentration.join(suspicious, "horizon_days").withColumn("any_forbidden_column", violation).withColumn(
        "overall_pass", ~F.col("any_suspicious_feature") & ~F.col("any_forbidden_column") & ~F.col("dominant")
    )


def role(frame: DataFrame, name: str) -> DataFrame:
    return frame.where(F.col("frame_role") == name)


def fit_all(frame: DataFrame, forest: dict, boosting: dict) -> dict[str, dict[int, models.Model]]:
    """Every model at every horizon of the frame.

    The trees of all horizons grow together from one binned table; the logistic fits, whose iterations are
    short jobs, run beside them in threads of this session.
    """
    train, columns = role(frame, "train"), feature_columns()
    rows = models.training_rows(train, columns, "horizon_days")
    with ThreadPoolExecutor(max_workers=2 + len(rows.counts)) as pool:
        logistic = {h: pool.submit(models.fit_logistic, train.where(F.col("horizon_days") == h), columns) for h in sorted(rows.counts)}
        boosted, forests = pool.submit(models.fit_boostings, rows, **boosting), pool.submit(models.fit_forests, rows, **forest)
        return {
            "logistic_regression": {h: f.result() for h, f in logistic.items()},
            "random_forest": forests.result(),
            "gradient_boosting": boosted.result(),
        }


def score_all(frame: DataFrame, fitted: dict[str, dict[int, models.Model]]) -> DataFrame:
    """Long by model: one scored copy of the held-out rows per model, written once.

    ``score`` ranks and meets thresholds; for these models it is the probability.
    """
    held_out = frame.where(F.col("frame_role") != "train")
    parts = [
        models.predict(m, held_out.where(F.col("horizon_days") == h)).select(
            *SCORED, "probability", F.col("probability").alias("score"), F.lit(name).alias("model")
        )
        for name, by_horizon in fitted.items()
        for h, m in by_horizon.items()
    ]
    return written(reduce(DataFrame.unionByName, parts), "scored")


def baseline_scores(frame: DataFrame) -> DataFrame:
    """The threshold baseline in the same form: the signal as score, scaled by its training range as probability."""
    ranges = role(frame, "train").groupBy("horizon_days").agg(F.min(BASELINE_SIGNAL).alias("low"), F.max(BASELINE_SIGNAL).alias("high"))
    held_out = frame.where(F.col("frame_role") != "train").join(ranges, "horizon_days")
    probability = metrics.pseudo_probability(F.col(BASELINE_SIGNAL), F.col("low"), F.col("high"))
    return held_out.select(*SCORED, probability.alias("probability"), F.col(BASELINE_SIGNAL).alias("score"), F.lit(BASELINE).alias("model"))


def decide(scored: DataFrame) -> DataFrame:
    """Add the F1-maximising threshold of the validation rows and what it predicts."""
    chosen = metrics.ranking_metrics(metrics.score_table(role(scored, "val"), BY, "score"), BY).select(
        *BY, F.col("best_f1_threshold").alias("decision_threshold")
    )
    return scored.join(chosen, BY).withColumn("predicted", F.col("score") >= F.col("decision_threshold"))


def classification(decided: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = metrics.threshold_metrics(metrics.confusion(decided, by))
    ranks = metrics.ranking_metrics(metrics.score_table(decided, by, "score"), by)
    return counts.join(ranks.select(*by, "pr_auc", "roc_auc"), list(by))


def compare(decided: DataFrame) -> DataFrame:
    """A row per model and horizon: threshold, test and stress metrics, calibration, cost and lead time."""
    by = [*BY, "decision_threshold"]
    test, stress = role(decided, "normal_test"), role(decided, "stress_test")
    prefixed = classification(stress, BY)
    prefixed = prefixed.select(*BY, *[F.col(c).alias(f"stress_{c}") for c in prefixed.columns if c not in BY])
    ratio = metrics.false_positive_cost(metrics.confusion(test, BY)).select(*BY, "false_positives_per_true_positive").distinct()
    lead = episodes.lead_time_summary(lead_times(test), BY).select(*BY, "median_warning_lead_time_days", "n_episodes_total", "n_early_warning")
    out = classification(test, by)
    for part in (prefixed, metrics.calibration_assessment(test, BY, "probability"), ratio, lead):
        out = out.join(part, BY, "left")
    return out


def lead_times(test: DataFrame) -> DataFrame:
    return written(episodes.warning_lead_times(test, keys=[*BY, "merchant_id"], horizon="horizon_days"), "leads")


def calibrated_forest(frame: DataFrame, forest: dict) -> tuple[models.Artifact, DataFrame]:
    """Forest on train, sigmoid on half of validation, threshold on the other half."""
    columns = feature_columns()
    model = models.fit_forest(role(frame, "train"), columns, **forest)
    val = models.predict(model, role(frame, "val"), "probability_raw").select(*ID_COLUMNS, "probability_raw")
    halves = written(splits.calibration_halves(val, LABEL, ["merchant_id", "day_index"]), "halves")
    platt = models.fit_platt(halves.where(F.col("half") == "calibration"), "probability_raw")
    held = halves.where(F.col("half") == "threshold").withColumn("probability", platt.apply(F.col("probability_raw")))
    best = metrics.ranking_metrics(metrics.score_table(held, [], "probability"), []).first()
    horizon = frame.select("horizon_days").first()["horizon_days"]
    artifact = models.Artifact(model, platt, int(horizon), float(best["best_f1_threshold"]), columns)
    return artifact, halves


VARIANT = ["variant", "frame_role"]


def calibration_report(frame: DataFrame, artifact: models.Artifact, halves: DataFrame) -> DataFrame:
    """Uncalibrated and calibrated forest on test and stress rows, each with its own threshold from the held half.

    Lead time is that of test rows; stress rows have none.
    """
    held = halves.where(F.col("half") == "threshold")
    raw_best = metrics.ranking_metrics(metrics.score_table(held, [], "probability_raw"), []).first()["best_f1_threshold"]
    rows = artifact.score(frame.where(F.col("frame_role").isin("normal_test", "stress_test")))
    kinds = {"uncalibrated": ("probability_raw", raw_best), "calibrated": ("probability", artifact.decision_threshold)}
    options = [F.struct(F.lit(v).alias("variant"), F.col(p).alias("p"), F.lit(t).alias("t")) for v, (p, t) in kinds.items()]
    each = rows.select(*ID_COLUMNS, F.explode(F.array(*options)).alias("v"))
    variants = written(
        each.select(*ID_COLUMNS, "v.variant", F.col("v.p").alias("probability"), F.col("v.t").alias("threshold"), (F.col("v.p") >= F.col("v.t")).alias("predicted")),
        "variants",
    )
    ranks = metrics.ranking_metrics(metrics.score_table(variants, VARIANT, "probability"), VARIANT).select(*VARIANT, "pr_auc", "roc_auc")
    counts = metrics.confusion(variants, [*VARIANT, "threshold"])
    ratio = metrics.false_positive_cost(counts).select(*VARIANT, "false_positives_per_true_positive").distinct()
    found = episodes.warning_lead_times(role(variants, "normal_test"), keys=["variant", "horizon_days", "merchant_id"], horizon="horizon_days")
    lead = episodes.lead_time_summary(written(found, "leads"), ["variant"]).select(
        "variant", F.lit("normal_test").alias("frame_role"), "median_warning_lead_time_days", "n_episodes_total", "n_early_warning"
    )
    out = metrics.threshold_metrics(counts)
    for part in (ranks, metrics.calibration_assessment(variants, VARIANT, "probability"), ratio, lead):
        out = out.join(part, VARIANT, "left")
    return out


def leakage_checks(frame: DataFrame, artifact: models.Artifact, halves: DataFrame) -> DataFrame:
    """(check, holds): halves are disjoint, were drawn from validation rows alone, no test row was fitted on, and
    fitting the forest again on the same rows gives the same importances."""
    keys = ["merchant_id", "day_index"]
    sets = {h: halves.where(F.col("half") == h).select(*keys) for h in ("calibration", "threshold")}
    sets |= {r: role(frame, r).select(*keys) for r in ("train", "val", "normal_test", "stress_test")}
    shared = {(r["left_set"], r["right_set"]): r["n_shared"] for r in row_overlaps(sets, keys).collect()}
    rows = {h: df.count() for h, df in sets.items()}
    fitted, tested = ("train", "calibration", "threshold"), ("normal_test", "stress_test")
    plan = artifact.model.plan
    again = models.fit_forest(role(frame, "train"), artifact.feature_columns, numTrees=plan.trees, maxDepth=plan.depth, maxBins=plan.bins, minInstancesPerNode=plan.least_rows)
    # Cut points are approximate quantiles, so a split may move to a neighbouring value when rows arrive in another order.
    steady = bool(abs(again.importances() - artifact.model.importances()).max() <= 0.02)
    checks = [
        ("calibration_and_threshold_rows_disjoint", shared["calibration", "threshold"] == 0),
        ("calibration_rows_are_validation_rows", shared["calibration", "val"] == rows["calibration"] and shared["threshold", "val"] == rows["threshold"]),
        ("no_test_row_was_fitted_on", sum(shared.get((f, t), 0) + shared.get((t, f), 0) for f in fitted for t in tested) == 0),
        ("refit_gives_the_same_importances", steady),
    ]
    return frame.sparkSession.createDataFrame(checks, "check string, holds boolean")
