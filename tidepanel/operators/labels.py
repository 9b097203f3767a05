"""Forward-looking elevation labels at several horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import ratio_or_zero
from tidepanel.operators import windows as W
from tidepanel.sources.schemas import LABELS

# Label definition.
HORIZONS = [7, 14, 30]
TRAILING_WINDOW_DAYS = 28
ELEVATION_RATIO_THRESHOLD = 1.75
MIN_ABSOLUTE_FLOOR = 50.0
MIN_GMV_FRACTION_FLOOR = 0.0005
MIN_EXPECTED_AMOUNT = 1.0
MIN_BASELINE_RATE = 1e-4

_INPUTS = ["gmv", "transaction_count", "chargeback_amount", "chargeback_count"]


def build_labels(daily: DataFrame, horizons: list[int] | None = None) -> DataFrame:
    """Long by horizon; days whose future window is incomplete have no row.

    Every sum, past or future, is a difference of the same four running totals, so the
    whole table costs one pass over each entity's days.
    """
    horizons = horizons or HORIZONS
    span = TRAILING_WINDOW_DAYS
    order = W.entity_order()
    scale = {c: W._integer_scale(daily.schema[c].dataType) for c in _INPUTS}

    def units(name: str):
        value = F.col(name)
        return (value * scale[name]).cast("long") if scale[name] else value.cast("double")

    running = daily.select(
        "merchant_id",
        "date",
        *[F.sum(units(c)).over(W.so_far()).alias(f"_{c}") for c in _INPUTS],
        F.row_number().over(order).cast("long").alias("_row"),
        F.col("day_index"),
    )

    def amount(name: str, total):
        return total.cast("double") / float(scale[name] or 1)

    def past(name: str):
        run = F.col(f"_{name}")
        return amount(name, run - F.coalesce(F.lag(run, span).over(order), F.lit(0)))

    def future(name: str, h: int):
        run = F.col(f"_{name}")
        return amount(name, F.lead(run, h).over(order) - run)

    per_horizon = F.array(
        *[
            F.struct(
                F.lit(h).cast("long").alias("horizon_days"),
                *[future(c, h).alias(f"future_{c}") for c in _INPUTS if c != "gmv"],
            )
            for h in horizons
        ]
    )
    wide = running.select(
        "merchant_id",
        F.col("date").alias("as_of_date"),
        (F.col("_row") - 1).alias("day_index"),
        F.least(F.col("_row"), F.lit(span)).alias("days"),
        *[past(c).alias(f"past_{c}") for c in _INPUTS],
        per_horizon.alias("horizons"),
    )
    long = wide.select("*", F.explode("horizons").alias("h")).drop("horizons").select("*", "h.*").drop("h")
    # lead() is null exactly where the future window runs past the entity's last day.
    complete = long.where(F.col("future_transaction_count").isNotNull())

    h = F.col("horizon_days")
    gmv_base = F.col("past_gmv") / F.col("days")
    amount_base = F.col("past_chargeback_amount") / F.col("days")
    rate_base = ratio_or_zero(F.col("past_chargeback_count"), F.col("past_transaction_count"))
    future_amount = F.col("future_chargeback_amount")
    future_rate = ratio_or_zero(F.col("future_chargeback_count"), F.col("future_transaction_count"))
    ratio = future_amount / F.greatest(amount_base * h, F.lit(MIN_EXPECTED_AMOUNT))
    floor = F.greatest(F.lit(MIN_ABSOLUTE_FLOOR), gmv_base * h * MIN_GMV_FRACTION_FLOOR)
    elevated = (ratio >= ELEVATION_RATIO_THRESHOLD) & (future_amount >= floor)
    return complete.select(
        "merchant_id",
        "as_of_date",
        "day_index",
        "horizon_days",
        future_amount.alias("future_chargeback_amount"),
        future_rate.alias("future_chargeback_rate"),
        F.col("future_transaction_count").cast("long").alias("future_transaction_count"),
        gmv_base.alias("baseline_daily_gmv_trailing"),
        amount_base.alias("baseline_daily_chargeback_amount_trailing"),
        rate_base.alias("baseline_chargeback_rate_trailing"),
        ratio.alias("elevation_ratio_amount"),
        (future_rate / F.greatest(rate_base, F.lit(MIN_BASELINE_RATE))).alias("elevation_ratio_rate"),
        elevated.cast("long").alias("label_elevated_chargeback"),
    ).select(*LABELS.fieldNames())
