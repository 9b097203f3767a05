"""Gaps and islands, alert lead time and late detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import count_where
from tidepanel.functions.ordered import exact_quantiles


def runs_of(rows: DataFrame, keys: Sequence[str], day: str) -> GroupedData:
    """Group rows into maximal runs of adjacent day numbers within the keys.

    Within a run the day number and the row number advance together, so their difference
    identifies the run.
    """
    order = Window.partitionBy(*keys).orderBy(day)
    return rows.withColumn("_run", F.col(day) - F.row_number().over(order)).groupBy(*keys, "_run")


def label_episodes(frame: DataFrame, keys: Sequence[str], day: str, label: str) -> DataFrame:
    """Maximal runs of label = 1 over adjacent *rows*: (keys, onset_day, end_day, first_day)."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(day)
    changed = F.coalesce((F.lag(label).over(order) != F.col(label)).cast("long"), F.lit(1))
    return (
        frame.select(*keys, day, label, changed.alias("_changed"), F.min(day).over(Window.partitionBy(*keys)).alias("first_day"))
        .withColumn("_block", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col(label) == 1)
        .groupBy(*keys, "first_day", "_block")
        .agg(F.min(day).alias("onset_day"), F.max(day).alias("end_day"))
        .drop("_block")
    )


def warning_lead_times(
    frame: DataFrame,
    horizon_days: int | None = None,
    keys: Sequence[str] = ("merchant_id",),
    day: str = "day_index",
    label: str = "label_elevated_chargeback",
    predicted: str = "predicted",
    horizon: str | None = None,
) -> DataFrame:
    """One row per episode with its status and lead time or late offset.

    An alert counts as early only if an unbroken run of positive predictions over adjacent
    day numbers reaches the day before onset; its start is clipped to the horizon and to
    the first day of the frame.  ``horizon`` names a key column holding the horizon, for
    frames that stack several.

    Each row carries the start of the alert run it continues, so an episode reads its lead
    off its own onset row: episodes and alert runs are never paired.
    """
    keys = list(keys)
    h = F.col(horizon) if horizon else F.lit(horizon_days)
    order = Window.partitionBy(*keys).orderBy(day)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    yes = F.col(predicted).cast("boolean")
    follows_alert = (F.lag(day).over(order) == F.col(day) - 1) & F.lag(yes).over(order)
    marked = frame.select(
        *keys,
        day,
        label,
        yes.alias("_yes"),
        F.coalesce(follows_alert, F.lit(False)).alias("_follows"),
        F.coalesce((F.lag(label).over(order) != F.col(label)).cast("long"), F.lit(1)).alias("_changed"),
        F.min(day).over(Window.partitionBy(*keys)).alias("first_day"),
    )
    runs = marked.select(
        "*",
        F.sum("_changed").over(so_far).alias("_block"),
        F.last(F.when(F.col("_yes") & ~F.col("_follows"), F.col(day)), ignorenulls=True).over(so_far).alias("_start"),
    )
    matched = (
        runs.select("*", F.when(F.col("_follows"), F.lag("_start").over(order)).alias("_lead"))
        .where(F.col(label) == 1)
        .groupBy(*keys, "first_day", "_block")
        .agg(
            F.min(day).alias("onset_day"),
            F.max(day).alias("end_day"),
            F.min_by("_lead", day).alias("lead_start"),
            F.min(F.when(F.col("_yes"), F.col(day))).alias("late_day"),
        )
    )
    lookback = F.greatest(F.col("onset_day") - h, F.col("first_day"))
    early = F.col("lead_start").isNotNull() & (F.col("onset_day") - 1 >= lookback)
    status = (
        F.when(early, "early").when(F.col("late_day").isNotNull(), "detected_at_or_after_onset").otherwise("missed")
    )
    return matched.select(
        *keys,
        "onset_day",
        "end_day",
        status.alias("status"),
        F.when(early, F.col("onset_day") - F.greatest(F.col("lead_start"), lookback)).alias("lead_time_days"),
        F.when(~early, F.col("late_day") - F.col("onset_day")).alias("offset_days"),
    )


# Percentiles reported for early-warning lead times.
LEAD_PERCENTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def lead_time_summary(episodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by status, lead-time percentiles and the early fraction, per group."""
    by = list(by)
    counts = episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes_total"),
        count_where(F.col("status") == "early").alias("n_early_warning"),
        count_where(F.col("status") == "detected_at_or_after_onset").alias("n_detected_at_or_after_onset"),
        count_where(F.col("status") == "missed").alias("n_missed"),
    )
    leads = exact_quantiles(episodes, by, "lead_time_days", LEAD_PERCENTILES)
    if by:
        joined = counts.join(leads, by, "left")
    else:
        joined = counts.withColumns({p: leads.select(p).scalar() for p in LEAD_PERCENTILES})
    return joined.select(
        *by,
        "n_episodes_total",
        "n_early_warning",
        "n_detected_at_or_after_onset",
        "n_missed",
        F.col("p50").alias("median_warning_lead_time_days"),
        *LEAD_PERCENTILES,
        F.when(F.col("n_episodes_total") > 0, F.col("n_early_warning") / F.col("n_episodes_total")).alias(
            "fraction_episodes_with_early_warning"
        ),
    )
