"""Interval and event-aligned joins.

An interval meets a daily panel by expanding to its days and joining on (entity, day).
That is an equi-join whose work is the number of days covered, with no pair enumeration
between an entity's intervals and its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import count_where, ratio_or_null
from tidepanel.functions.ordered import exact_quantiles
from tidepanel.operators import windows as W

# Offsets and thresholds of the warning-structure check.
PRE_OFFSETS = (-20, -1)
REPORT_OFFSETS = (-20, 60)
DETECT_OFFSETS = (3, 70)
MIN_PRE_VALUES = 5
UPLIFT_FACTOR, UPLIFT_STEP, UPLIFT_FLOOR = 1.3, 0.003, 0.004


def interval_days(events: DataFrame, start: str, end: str, day: str = "date") -> DataFrame:
    """One row per interval and covered day."""
    return events.where(F.col(start) <= F.col(end)).select("*", F.explode(F.sequence(start, end)).alias(day))


def tag_active_event(daily: DataFrame, events: DataFrame) -> DataFrame:
    """Add the active event type and category of each entity-day, ``normal`` where there is none.

    Where intervals overlap, the one that starts last wins, then the larger event id.
    """
    active = (
        interval_days(events, "start_date", "recovery_end_date")
        .groupBy("merchant_id", "date")
        .agg(
            F.max_by(F.struct("event_type", "category"), F.struct("start_date", "event_id")).alias("_active")
        )
    )
    return daily.join(active, ["merchant_id", "date"], "left").select(
        *daily.columns,
        F.coalesce("_active.event_type", F.lit("normal")).alias("active_event_type"),
        F.coalesce("_active.category", F.lit("normal")).alias("active_event_category"),
    )


def align_to_events(daily: DataFrame, events: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """(event_id, event_type, offset, value) for day offsets low..high around each event start."""
    offsets = events.select(
        "event_id",
        "event_type",
        "merchant_id",
        "start_date",
        F.explode(F.sequence(F.lit(low), F.lit(high))).alias("offset"),
    ).withColumn("date", F.date_add("start_date", F.col("offset")))
    return offsets.join(daily.select("merchant_id", "date", value), ["merchant_id", "date"]).select(
        "event_id", "event_type", "offset", value
    )


def aligned_chargeback_rate(daily: DataFrame, events: DataFrame) -> DataFrame:
    rate = W.trailing_rate_unfloored(F.col("chargeback_count"), F.col("transaction_count"), W.WINDOW_SHORT)
    rated = daily.select("merchant_id", "date", "day_index", rate.alias("rate"))
    return align_to_events(rated, events.where(F.col("category") == "risk"), "rate", PRE_OFFSETS[0], DETECT_OFFSETS[1] + 2)


def uplift_detection(aligned: DataFrame) -> DataFrame:
    """Per event: pre-event baseline and first offset whose next three days average above it."""
    pre = F.col("offset").between(*PRE_OFFSETS)
    ahead = Window.partitionBy("event_id").orderBy("offset").rangeBetween(0, 2)
    baseline = F.avg(F.when(pre, F.col("rate"))).over(Window.partitionBy("event_id"))
    n_pre = F.count(F.when(pre, F.col("rate"))).over(Window.partitionBy("event_id"))
    marked = aligned.select(
        "event_id",
        "event_type",
        "offset",
        F.when(n_pre >= MIN_PRE_VALUES, baseline).alias("baseline"),
        F.when(F.count("rate").over(ahead) == 3, F.avg("rate").over(ahead)).alias("ahead"),
    )
    threshold = F.greatest(
        F.col("baseline") * UPLIFT_FACTOR, F.col("baseline") + UPLIFT_STEP, F.lit(UPLIFT_FLOOR)
    )
    hit = F.col("baseline").isNotNull() & F.col("offset").between(*DETECT_OFFSETS) & (F.col("ahead") >= threshold)
    return marked.groupBy("event_id", "event_type").agg(
        F.max("baseline").alias("baseline"), F.min(F.when(hit, F.col("offset"))).alias("detection_offset_days")
    )


def warning_structure(detections: DataFrame) -> DataFrame:
    """Detectability of each event type."""
    counts = detections.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_instances"),
        F.count("baseline").alias("n_instances_with_valid_pre_window"),
        F.count("detection_offset_days").alias("n_instances_with_detectable_uplift"),
    )
    spread = exact_quantiles(
        detections, ["event_type"], "detection_offset_days",
        {"p25_detection_offset_days": 0.25, "median_detection_offset_days": 0.5, "p75_detection_offset_days": 0.75},
    )
    return counts.join(spread, "event_type", "left").withColumn(
        "fraction_detectable",
        ratio_or_null(F.col("n_instances_with_detectable_uplift"), F.col("n_instances_with_valid_pre_window")),
    )


def mean_rate_by_offset(aligned: DataFrame) -> DataFrame:
    return (
        aligned.where(F.col("offset").between(*REPORT_OFFSETS))
        .groupBy("event_type", "offset")
        .agg(F.avg("rate").alias("mean_rate"), F.count("rate").alias("n_values"))
    )


def event_window_aggregates(daily: DataFrame, events: DataFrame) -> DataFrame:
    """Per event over [start, end]: chargebacks, refunds and the transaction-weighted on-time rate."""
    txn = F.col("transaction_count")
    weighted = F.sum(F.col("fulfillment_on_time_rate") * txn)
    covered = interval_days(events.select("event_id", "merchant_id", "start_date", "end_date"), "start_date", "end_date")
    return (
        covered.join(
            daily.select("merchant_id", "date", "transaction_count", "chargeback_count", "refund_count", "fulfillment_on_time_rate"),
            ["merchant_id", "date"],
        )
        .groupBy("event_id")
        .agg(
            F.sum("chargeback_count").alias("estimated_case_count"),
            F.sum("refund_count").alias("window_refund_count"),
            F.when(F.sum(txn) > 0, weighted / F.sum(txn)).otherwise(F.lit(1.0)).alias("window_on_time_rate"),
        )
    )


def detect_within_window(scores: DataFrame, events: DataFrame, flagged: str = "flagged") -> DataFrame:
    """Per event over [start, end]: first flagged day, flagged days and scored days."""
    covered = interval_days(events.select("event_id", "merchant_id", "start_date", "end_date"), "start_date", "end_date")
    return (
        covered.join(scores.select("merchant_id", "date", "day_index", flagged), ["merchant_id", "date"])
        .groupBy("event_id")
        .agg(
            F.min(F.when(F.col(flagged), F.col("date"))).alias("detected_date"),
            F.min(F.when(F.col(flagged), F.col("day_index"))).alias("detected_day_index"),
            count_where(F.col(flagged)).alias("n_flagged"),
            F.count(F.lit(1)).alias("n_days"),
        )
    )
