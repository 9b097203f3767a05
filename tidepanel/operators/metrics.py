"""Exact classification, calibration, cost and regression metrics.

All ranking metrics start from one table: distinct scores with their positive and negative
counts and the totals below each score.  Ties are therefore handled exactly, and nothing is
binned or interpolated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numeric import count_where
from tidepanel.functions.ordered import quantiles_from_counts, running_totals

LABEL = "label_elevated_chargeback"

# Baseline threshold grid, cost assumptions, calibration tolerance, audit limits.
GRID_START, GRID_STEP, GRID_SIZE = -3.0, 0.25, 53
COST_PER_FALSE_POSITIVE = 1.0
BENEFITS_PER_TRUE_POSITIVE = [2.0, 5.0, 10.0]
CALIBRATION_BINS = 10
CALIBRATION_TOLERANCE = 0.03
SUSPICIOUS_AUC = 0.97
DOMINANT_SHARE = 0.5
BOUNDARY_FRACTION = 0.1

# Calibration verdicts.
OVERCONFIDENT = "overconfident (predicted probabilities systematically higher than observed frequency)"
UNDERCONFIDENT = "underconfident (predicted probabilities systematically lower than observed frequency)"
CALIBRATED = "reasonably calibrated on average"


def score_table(df: DataFrame, keys: Sequence[str], score: str, label: str = LABEL) -> DataFrame:
    """(keys, score, pos, neg) over distinct scores plus ``*_before`` and ``*_total``."""
    s = F.col(score).cast("double")
    counts = (
        df.where(s.isNotNull() & ~F.isnan(s))
        .groupBy(*keys, s.alias("score"))
        .agg(count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) == 0).alias("neg"))
    )
    return running_totals(counts, keys, "score", ["pos", "neg"])


def _tp() -> Column:
    return F.col("pos_total") - F.col("pos_before")


def _fp() -> Column:
    return F.col("neg_total") - F.col("neg_before")


def _f1(tp: Column, fp: Column, positives: Column) -> Column:
    return F.when(tp > 0, 2 * tp / (tp + fp + positives)).otherwise(F.lit(0.0))


def ranking_metrics(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC (ties at half), average precision and the F1-maximising threshold per key.

    Among thresholds with the same F1 the lowest wins.  AUC is null if a class is empty.
    """
    p, n = F.max("pos_total"), F.max("neg_total")
    below = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    precision = _tp() / (_tp() + _fp())
    f1 = _f1(_tp(), _fp(), F.col("pos_total"))
    return table.groupBy(*keys).agg(
        p.alias("n_positive"),
        n.alias("n_negative"),
        F.when((p > 0) & (n > 0), below / (p * n)).alias("roc_auc"),
        F.when(p > 0, F.sum(F.col("pos") * precision) / p).alias("pr_auc"),
        F.min_by("score", F.struct(-f1, "score")).alias("best_f1_threshold"),
        F.max(f1).alias("best_f1"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, label: str = LABEL) -> DataFrame:
    return ranking_metrics(score_table(df, keys, score, label), keys).select(
        *keys, "n_positive", "n_negative", "roc_auc"
    )


def grid_threshold(df: DataFrame, keys: Sequence[str], signal: str, label: str = LABEL) -> DataFrame:
    """Grid threshold maximising F1, first wins; with the signal range used for scaling.

    A threshold's predictions depend only on how many grid points lie at or below the
    signal, so rows collapse to at most 54 cells per key before the grid is considered.
    """
    keys = list(keys)
    s = F.col(signal)
    cell = F.least(F.greatest(F.floor((s - GRID_START) / GRID_STEP), F.lit(-1)), F.lit(GRID_SIZE - 1))
    cells = df.groupBy(*keys, cell.alias("cell")).agg(
        count_where(F.col(label) == 1).alias("pos"),
        count_where(F.col(label) == 0).alias("neg"),
        F.min(s).alias("lo"),
        F.max(s).alias("hi"),
    )
    per_key = cells.groupBy(*keys).agg(
        F.collect_list(F.struct("cell", "pos", "neg")).alias("cells"),
        F.min("lo").alias("signal_min"),
        F.max("hi").alias("signal_max"),
    )

    def total_from(point: Column, name: str) -> Column:
        return F.aggregate(
            "cells", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["cell"] >= point, x[name]).otherwise(F.lit(0))
        )

    points = per_key.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))).alias("point"))
    counted = points.select(
        *keys,
        "signal_min",
        "signal_max",
        (F.lit(GRID_START) + F.lit(GRID_STEP) * F.col("point")).alias("threshold"),
        total_from(F.col("point"), "pos").alias("tp"),
        total_from(F.col("point"), "neg").alias("fp"),
        total_from(F.lit(-1), "pos").alias("p"),
    )
    f1 = _f1(F.col("tp"), F.col("fp"), F.col("p"))
    return counted.groupBy(*keys).agg(
        F.min_by("threshold", F.struct(-f1, "threshold")).alias("threshold"),
        F.max(f1).alias("train_f1"),
        F.max("signal_min").alias("signal_min"),
        F.max("signal_max").alias("signal_max"),
    )


def pseudo_probability(signal: Column, low: Column, high: Column) -> Column:
    """Min-max scaling by the training range, clipped to [0, 1]."""
    scaled = (signal - low) / F.greatest(high - low, F.lit(1e-9))
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))


def confusion(df: DataFrame, keys: Sequence[str], predicted: str = "predicted", label: str = LABEL) -> DataFrame:
    yes, positive = F.col(predicted).cast("boolean"), F.col(label) == 1
    return df.groupBy(*keys).agg(
        count_where(~yes & ~positive).alias("tn"),
        count_where(yes & ~positive).alias("fp"),
        count_where(~yes & positive).alias("fn"),
        count_where(yes & positive).alias("tp"),
    )


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from confusion counts; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def safe(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    return counts.select(
        "*",
        (F.col("tn") + fp + fn + tp).alias("n_total"),
        safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def false_positive_cost(counts: DataFrame) -> DataFrame:
    """One row per benefit assumption; a ratio without true positives is infinite."""
    tp, fp = F.col("tp"), F.col("fp")
    return counts.select(
        "*",
        (fp * COST_PER_FALSE_POSITIVE).alias("total_fp_cost_units"),
        F.when(tp > 0, fp / tp).otherwise(F.lit(float("inf"))).alias("false_positives_per_true_positive"),
        F.explode(F.array(*[F.lit(b) for b in BENEFITS_PER_TRUE_POSITIVE])).alias("assumed_benefit_per_true_positive"),
    ).withColumn("net_value_units", F.col("assumed_benefit_per_true_positive") * tp - fp * COST_PER_FALSE_POSITIVE)


def reliability_curve(df: DataFrame, keys: Sequence[str], probability: str, label: str = LABEL) -> DataFrame:
    """Quantile-bin reliability curve; bins are left-open and empty bins do not appear."""
    keys = list(keys)
    p = F.least(F.greatest(F.col(probability), F.lit(0.0)), F.lit(1.0))
    counts = df.groupBy(*keys, p.alias("value")).agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col(label) == 1).alias("pos")
    )
    inner = {f"e{i}": i / CALIBRATION_BINS for i in range(1, CALIBRATION_BINS)}
    edges = quantiles_from_counts(counts.select(*keys, "value", "n"), keys, inner).select(
        *keys, F.array(*inner).alias("edges")
    )
    joined = counts.join(edges, keys) if keys else counts.withColumn("edges", edges.select("edges").scalar())
    binned = joined.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        (F.sum("pos") / F.sum("n")).alias("observed_frequency"),
    )


def calibration_assessment(df: DataFrame, keys: Sequence[str], probability: str, label: str = LABEL) -> DataFrame:
    """Brier score, mean gap over the reliability bins and a verdict, per key."""
    keys = list(keys)
    p = F.least(F.greatest(F.col(probability), F.lit(0.0)), F.lit(1.0))
    brier = df.groupBy(*keys).agg(F.avg((p - F.col(label)) * (p - F.col(label))).alias("brier_score"))
    gaps = reliability_curve(df, keys, probability, label).groupBy(*keys).agg(
        F.avg(F.col("mean_predicted") - F.col("observed_frequency")).alias("mean_predicted_minus_observed")
    )
    gap = F.col("mean_predicted_minus_observed")
    verdict = (
        F.when(gap.isNull() | F.isnan(gap), "insufficient data")
        .when(gap > CALIBRATION_TOLERANCE, OVERCONFIDENT)
        .when(gap < -CALIBRATION_TOLERANCE, UNDERCONFIDENT)
        .otherwise(CALIBRATED)
    )
    joined = (
        brier.join(gaps, keys, "left")
        if keys
        else brier.withColumn("mean_predicted_minus_observed", gaps.scalar())
    )
    return joined.withColumn("verdict", verdict)


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    mean = F.avg(actual)
    mae = F.avg(F.abs(error))
    return df.groupBy(*keys).agg(
        mae.alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        mean.alias("mean_true_value"),
        F.when(mean > 0, 100 * mae / mean).alias("normalized_mae_pct_of_mean"),
    )


# --- error analysis -------------------------------------------------------------------------


def error_type(predicted: Column, label: Column) -> Column:
    yes, positive = predicted.cast("boolean"), label == 1
    return (
        F.when(yes & ~positive, "false_positive")
        .when(~yes & positive, "false_negative")
        .when(yes & positive, "true_positive")
        .when(~yes & ~positive, "true_negative")
        .otherwise("unknown")
    )


def volume_bucket(value: Column, median: Column) -> Column:
    return F.when(value < median, "low_volume").otherwise("higher_volume")


def error_breakdown(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """Counts of false positives and negatives per key by value of each dimension."""
    by = [*keys, "error_type"]
    return (
        df.where(F.col("error_type").isin("false_positive", "false_negative"))
        .select(*by, *dimensions)
        .unpivot(by, list(dimensions), "dimension", "value")
        .groupBy(*by, "dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def error_rates(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str], label: str = LABEL) -> DataFrame:
    """Error rate per key within each category: FPs among negatives and FNs among positives."""
    return (
        df.select(
            *keys,
            F.when(F.col(label) == 1, "false_negative").otherwise("false_positive").alias("error"),
            "error_type",
            *dimensions,
        )
        .unpivot([*keys, "error", "error_type"], list(dimensions), "dimension", "value")
        .groupBy(*keys, "error", "dimension", "value")
        .agg(
            count_where(F.col("error_type") == F.col("error")).alias("n_errors"),
            F.count(F.lit(1)).alias("n_total_in_category"),
        )
        .withColumn("rate", F.col("n_errors") / F.col("n_total_in_category"))
    )


# Limits and verdicts of the difficulty audit.
TOO_EASY_AUC, TOO_HARD_AUC = 0.97, 0.55
TOO_EASY = "a causal feature alone is close to perfect: look for leakage"
TOO_HARD = "causal features alone are weak at some horizon: the label may be hard to learn there"
PLAUSIBLE = "causal features alone carry some signal and do not settle the label"


def difficulty_assessment(aucs: DataFrame, causal: Sequence[str]) -> DataFrame:
    """One row over (feature, roc_auc): the extreme AUCs of the causal features and the verdicts they call for."""
    extremes = aucs.where(F.col("feature").isin(list(causal))).agg(
        F.max("roc_auc").alias("highest_auc"), F.min("roc_auc").alias("lowest_auc")
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("highest_auc") > TOO_EASY_AUC, TOO_EASY),
            F.when(F.col("lowest_auc") < TOO_HARD_AUC, TOO_HARD),
        )
    )
    return extremes.withColumn(
        "assessment", F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(F.lit(PLAUSIBLE))
    )


def single_feature_audit(long: DataFrame, keys: Sequence[str], label: str = LABEL) -> DataFrame:
    """AUC of each feature of a (keys, feature, value, label) frame, ranked by |AUC - 0.5|."""
    from pyspark.sql import Window

    keys = list(keys)
    auc = roc_auc(long, [*keys, "feature"], "value", label)
    # Features whose AUCs agree to six digits rank by name, so that rank does not hang on the last bits.
    strength = F.round(F.abs(F.col("roc_auc") - 0.5), 6)
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        strength.desc_nulls_last(), "feature"
    )
    # One row per feature and key: the ranking window is bounded by the feature count.
    return auc.select(
        *keys,
        "feature",
        "roc_auc",
        F.row_number().over(order).alias("rank"),
        F.coalesce(F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")) >= SUSPICIOUS_AUC, F.lit(False)).alias("suspicious"),
    )


def importance_concentration(importances: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Share of the top feature of each model, dominant from one half."""
    total = F.sum("importance")
    share = F.max("importance") / F.when(total == 0, F.lit(1.0)).otherwise(total)
    return importances.groupBy(*keys).agg(
        F.max_by("feature", F.struct("importance", "feature")).alias("top_feature"),
        share.alias("top_feature_importance_share"),
        (share >= DOMINANT_SHARE).alias("dominant"),
    )
