"""Entity and date resolution, listings, profiles and lagged lookups, in bulk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.quality import long_form
from tidepanel.sources.schemas import PANEL_KEYS

# Attributes a profile may show.
PROFILE_COLUMNS = ["merchant_id", "archetype", "business_tier", "signup_date"]
SNAPSHOT_COLUMNS = [
    "gmv",
    "transaction_count",
    "chargeback_rate",
    "refund_rate",
    "fulfillment_on_time_rate",
    "liquidity_balance",
]


def known_entities(requests: DataFrame, dimension: DataFrame) -> DataFrame:
    return requests.join(dimension.select("merchant_id"), "merchant_id", "left_semi")


def unknown_entities(requests: DataFrame, dimension: DataFrame) -> DataFrame:
    return requests.join(dimension.select("merchant_id"), "merchant_id", "left_anti")


def entity_ranges(daily: DataFrame) -> DataFrame:
    return daily.groupBy("merchant_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def resolve_day_index(requests: DataFrame, daily: DataFrame) -> DataFrame:
    """Add ``day_index`` and ``resolution``: ok, merchant_not_found or date_not_available.

    A date outside an entity's history keeps its row and reports that entity's valid range.
    """
    resolved = requests.join(daily.select(*PANEL_KEYS), ["merchant_id", "date"], "left").join(
        entity_ranges(daily), "merchant_id", "left"
    )
    status = (
        F.when(F.col("first_date").isNull(), "merchant_not_found")
        .when(F.col("day_index").isNull(), "date_not_available")
        .otherwise("ok")
    )
    return resolved.withColumn("resolution", status)


def latest_days(daily: DataFrame) -> DataFrame:
    return daily.groupBy("merchant_id").agg(
        F.max("day_index").alias("day_index"), F.max_by("date", "day_index").alias("date")
    )


def list_entities(dimension: DataFrame, archetype: str | None = None) -> DataFrame:
    listed = dimension if archetype is None else dimension.where(F.col("archetype") == archetype)
    return listed.select(*PROFILE_COLUMNS).orderBy("merchant_id")


def entity_profiles(daily: DataFrame, dimension: DataFrame) -> DataFrame:
    """History extent and the latest observed day, as a struct, per entity."""
    history = daily.groupBy("merchant_id").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_days"),
        F.max_by(F.struct(F.col("date").alias("as_of_date"), "day_index", *SNAPSHOT_COLUMNS), "day_index").alias("latest"),
    )
    return dimension.select(*PROFILE_COLUMNS, "weekly_seasonality_profile").join(history, "merchant_id")


def last_observations(
    daily: DataFrame, limit: int | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows in an inclusive date range, then each entity's last ``limit`` of them."""
    rows = daily
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    if limit is None:
        return rows
    latest_first = Window.partitionBy("merchant_id").orderBy(F.desc("day_index"))
    return rows.withColumn("_rank", F.row_number().over(latest_first)).where(F.col("_rank") <= limit).drop("_rank")


def feature_long(features: DataFrame, manifest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value, group, definition, window, kind); unknown names get placeholders."""
    long = long_form(features, PANEL_KEYS, columns, "feature")
    # The manifest has one row per feature column, so it is bounded by the schema.
    return with_metadata(long, manifest)


def with_metadata(rows: DataFrame, manifest: DataFrame, feature: str = "feature") -> DataFrame:
    meta = manifest.select(F.col("name").alias(feature), "group", "definition", "window", "kind")
    return rows.join(F.broadcast(meta), feature, "left").withColumns(
        {
            "group": F.coalesce("group", F.lit("unknown")),
            "definition": F.coalesce("definition", F.lit("No manifest entry found.")),
            "kind": F.coalesce("kind", F.lit("unknown")),
        }
    )


def score_trend(scores: DataFrame, score: str, days: int = 7) -> DataFrame:
    """Score now against the score ``days`` calendar days earlier; null where that day is absent."""
    earlier = scores.select(
        "merchant_id", F.date_add("date", days).alias("date"), F.col(score).alias("previous")
    )
    return scores.select("merchant_id", "date", F.col(score).alias("current")).join(
        earlier, ["merchant_id", "date"], "left"
    ).withColumn("change", F.col("current") - F.col("previous"))


def retrospective_exposure(requests: DataFrame, labels: DataFrame, horizon_days: int) -> DataFrame:
    """Realised future amount for each (merchant_id, date), ``available`` false where it has no label."""
    actual = labels.where(F.col("horizon_days") == horizon_days).select(
        "merchant_id", F.col("as_of_date").alias("date"), F.col("future_chargeback_amount").alias("actual_exposure")
    )
    return requests.join(actual, ["merchant_id", "date"], "left").withColumn(
        "available", F.col("actual_exposure").isNotNull()
    )
