"""Splits, the threshold baseline and its full evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.numeric import fixed
from tidepanel.operators import episodes, frames, intervals, metrics, quality, splits
from tidepanel.operators.features import feature_columns
from tidepanel.plans.evaluation import BASELINE_SIGNAL, baseline_predictions, roles_frame
from tidepanel.plans.registry import as_double, query, rounded
from tidepanel.sources.storage import written

KEYS = ["horizon_days", "frame_role"]


@query("entity_split")
def _(d):
    return splits.entity_split(d.dimension)


@query("entity_split_supplier", "supplier")
def _(d):
    return splits.entity_split(d.dimension)


@query("split_summary", "supplier")
def _(d):
    return splits.split_summary(splits.entity_split(d.dimension))


@query("split_coverage", "supplier")
def _(d):
    return splits.split_coverage(splits.entity_split(d.dimension), d.dimension)


@query("frame_roles")
def _(d):
    return (
        roles_frame(d, [])
        .groupBy("horizon_days", "frame_role")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label_elevated_chargeback").alias("n_positive"))
    )


@query("horizon_frame")
def _(d):
    return rounded(frames.horizon_frame(d.labels, d.features, d.dimension, [BASELINE_SIGNAL, "gmv_level_28d"]))


@query("join_cardinality_violations")
def _(d):
    # Event starts repeat when several signals fire on one day: the check has something to find.
    keys = ["merchant_id", "day_index"]
    starts = d.events.select("merchant_id", F.datediff("start_date", F.lit("1995-01-02").cast("date")).cast("long").alias("day_index"))
    return frames.one_to_one_violations(starts, d.features.select(*keys), keys).withColumnRenamed("count", "n")


@query("validation_halves")
def _(d):
    val = roles_frame(d, []).where((F.col("frame_role") == "val") & (F.col("horizon_days") == 30))
    return splits.calibration_halves(
        val.select("merchant_id", "day_index", "label_elevated_chargeback"), "label_elevated_chargeback", ["merchant_id", "day_index"]
    )


@query("row_set_overlaps")
def _(d):
    """Rows that validation halves and roles share at 30 days: none, but for the halves with the validation rows."""
    keys = ["merchant_id", "day_index"]
    rows = written(roles_frame(d, []).where(F.col("horizon_days") == 30).select(*keys, "frame_role", "label_elevated_chargeback"), "roles")
    val = rows.where(F.col("frame_role") == "val")
    halves = written(splits.calibration_halves(val, "label_elevated_chargeback", keys), "halves")
    sets = {h: halves.where(F.col("half") == h) for h in ("calibration", "threshold")}
    sets |= {r: rows.where(F.col("frame_role") == r) for r in ("train", "val", "normal_test", "stress_test")}
    return frames.row_overlaps(sets, keys)


@query("baseline_fit")
def _(d):
    train = roles_frame(d, [BASELINE_SIGNAL]).where(F.col("frame_role") == "train")
    return rounded(metrics.grid_threshold(train, ["horizon_days"], BASELINE_SIGNAL))


@query("baseline_ranking_metrics")
def _(d):
    scored = roles_frame(d, [BASELINE_SIGNAL])
    return rounded(metrics.ranking_metrics(metrics.score_table(scored, KEYS, BASELINE_SIGNAL), KEYS))


@query("baseline_threshold_metrics")
def _(d):
    return rounded(metrics.threshold_metrics(metrics.confusion(baseline_predictions(d), KEYS)))


@query("baseline_false_positive_cost")
def _(d):
    return rounded(metrics.false_positive_cost(metrics.confusion(baseline_predictions(d), KEYS)))


@query("baseline_reliability_curve")
def _(d):
    return rounded(metrics.reliability_curve(baseline_predictions(d), KEYS, "probability"))


@query("baseline_calibration")
def _(d):
    return rounded(metrics.calibration_assessment(baseline_predictions(d), KEYS, "probability"))


@query("baseline_lead_times")
def _(d):
    test = baseline_predictions(d).where(F.col("frame_role") == "normal_test")
    found = episodes.warning_lead_times(test, keys=["horizon_days", "merchant_id"], horizon="horizon_days")
    return as_double(found, "lead_time_days", "offset_days")


@query("baseline_lead_time_summary")
def _(d):
    test = baseline_predictions(d).where(F.col("frame_role") == "normal_test")
    found = written(
        episodes.warning_lead_times(test, keys=["horizon_days", "merchant_id"], horizon="horizon_days"), "lead_times"
    )
    return rounded(episodes.lead_time_summary(found, ["horizon_days"]))


@query("label_episodes")
def _(d):
    return episodes.label_episodes(
        d.labels, ["horizon_days", "merchant_id"], "day_index", "label_elevated_chargeback"
    )


def _errors(d):
    test = baseline_predictions(d, ["transaction_count_level_28d"]).where(F.col("frame_role") == "normal_test")
    tagged = intervals.tag_active_event(test.withColumn("date", F.col("as_of_date")), d.events)
    median = quality.exact_quantiles(test, ["horizon_days"], "transaction_count_level_28d", {"median_volume": 0.5})
    return tagged.join(median, "horizon_days").withColumns(
        {
            "error_type": metrics.error_type(F.col("predicted"), F.col("label_elevated_chargeback")),
            "volume_bucket": metrics.volume_bucket(F.col("transaction_count_level_28d"), F.col("median_volume")),
        }
    )


DIMENSIONS = ["active_event_type", "active_event_category", "archetype", "volume_bucket"]


@query("error_breakdown")
def _(d):
    return metrics.error_breakdown(_errors(d), ["horizon_days"], DIMENSIONS)


@query("error_rates")
def _(d):
    return rounded(metrics.error_rates(_errors(d), ["horizon_days"], ["active_event_type", "archetype"]))


@query("naive_forecast_metrics")
def _(d):
    frame = roles_frame(d, []).withColumn(
        "naive_forecast", F.col("baseline_daily_chargeback_amount_trailing") * F.col("horizon_days")
    )
    return rounded(metrics.regression_metrics(frame, KEYS, "future_chargeback_amount", "naive_forecast"), 4)


@query("single_feature_auc")
def _(d):
    """Every feature at every horizon, on values to six digits: a tie must not hang on a value's last bits."""
    train = roles_frame(d, feature_columns()).where(F.col("frame_role") == "train")
    long = quality.long_form(train, ["horizon_days", "label_elevated_chargeback"], feature_columns(), "feature")
    return rounded(metrics.single_feature_audit(long.withColumn("value", fixed(F.col("value"), 6)), ["horizon_days"]))


@query("all_feature_auc_top10")
def _(d):
    train = roles_frame(d, feature_columns()).where((F.col("frame_role") == "train") & (F.col("horizon_days") == 30))
    long = quality.long_form(train, ["label_elevated_chargeback"], feature_columns(), "feature")
    return rounded(metrics.single_feature_audit(long, []).where(F.col("rank") <= 10))


@query("threshold_comparison_table")
def _(d):
    """Model x horizon comparison rows for the baseline (the trained models add theirs)."""
    p = baseline_predictions(d)
    test = p.where(F.col("frame_role") == "normal_test")
    by = ["horizon_days"]
    cls = metrics.threshold_metrics(metrics.confusion(test, by)).select("horizon_days", "precision", "recall", "f1")
    rank = metrics.ranking_metrics(metrics.score_table(test, by, "score"), by).select("horizon_days", "pr_auc", "roc_auc")
    brier = metrics.calibration_assessment(test, by, "probability").select("horizon_days", "brier_score")
    stress = p.where(F.col("frame_role") == "stress_test")
    stress_cls = metrics.threshold_metrics(metrics.confusion(stress, by)).select("horizon_days", F.col("recall").alias("stress_recall"))
    found = written(
        episodes.warning_lead_times(test, keys=["horizon_days", "merchant_id"], horizon="horizon_days"), "lead_times"
    )
    lead = episodes.lead_time_summary(found, by).select("horizon_days", "median_warning_lead_time_days", "n_episodes_total", "n_early_warning")
    out = cls
    for part in (rank, brier, stress_cls, lead):
        out = out.join(part, by, "left")
    return rounded(out.withColumn("model", F.lit("historical_threshold_baseline")))
