"""Derive the daily panel, the entity table and the interval table from order lines.

The panel has one row per (merchant_id, date) with no gaps.  Lines are aggregated to (entity, day)
with map-side partial sums, so the rows one entity contributes to the panel's windows are bounded
by the calendar however many lines it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import count_where, ratio_or_zero
from tidepanel.functions.ordered import running_totals
from tidepanel.sources.schemas import DAILY, PANEL_KEYS, PAYMENT_METHODS
from tidepanel.operators.episodes import runs_of

# Order priority standing in for each payment method.
METHOD_PRIORITIES = {
    "card": "1-URGENT",
    "upi": "2-HIGH",
    "netbanking": "3-MEDIUM",
    "wallet": "4-NOT SPECIFIED",
    "bnpl": "5-LOW",
}

# Deviation signal -> (scenario type, category, direction, affected metrics).
SIGNALS = {
    "chargeback_rate_deviation_z": ("chargeback_deterioration", "risk", 1, "chargeback_rate"),
    "refund_rate_deviation_z": ("refund_shock", "risk", 1, "refund_rate"),
    "fulfillment_on_time_rate_deviation_z": (
        "fulfillment_degradation",
        "risk",
        -1,
        "fulfillment_on_time_rate,fulfillment_delay_avg_days",
    ),
    "new_customer_rate_deviation_z": ("customer_mix_shift", "risk", 1, "new_customer_rate"),
    "gmv_deviation_z": ("festival_growth", "benign_growth", 1, "gmv,transaction_count"),
}
SIGNAL_THRESHOLD_Z = 2.0
RECOVERY_DAYS = 7
LIQUIDITY_DAYS = 7
SETTLEMENT_DAYS = 3


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Entity level -> (key column of supplier, id format).
LEVELS = {"nation": ("s_nationkey", "NAT%02d"), "supplier": ("s_suppkey", "SUP%09d")}
# Entity levels whose days outnumber their cells: Spark sizes tasks by the cells, so none are joined there.
SPREAD_LEVELS = {"supplier"}


def _entity_key(level: str) -> Column:
    return F.col(LEVELS[level][0]).cast("long")


def _entity_id(level: str, key: Column) -> Column:
    return F.format_string(LEVELS[level][1], key)


def entity_days(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Non-empty (entity, day) cells; money in integer cents so sums are exact."""
    price_cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    discount_pct = F.round(F.col("l_discount") * 100).cast("long")
    lines = (
        read(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey",
            "l_suppkey",
            F.to_date("l_shipdate").alias("day"),
            F.floor((price_cents * (100 - discount_pct) + 50) / 100).alias("net"),
            F.col("l_quantity").cast("long").alias("quantity"),
            "l_returnflag",
            "l_linestatus",
        )
        .join(
            read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(
            read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"),
            F.col("l_suppkey") == F.col("s_suppkey"),
        )
        .withColumn("entity", _entity_key(level))
    )
    refunded = F.col("l_returnflag") == "R"
    charged_back = F.col("l_returnflag") == "A"

    def net_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("net")).otherwise(F.lit(0)))

    # Lines move once; in the order of a customer's days the first line of a day counts the customer.
    visits = Window.partitionBy("entity", "customer").orderBy("day")
    first_day = F.min("day").over(visits.rowsBetween(Window.unboundedPreceding, 0))
    told = (
        lines.withColumnRenamed("o_custkey", "customer")
        .withColumns({"_row": F.row_number().over(visits), "_before": F.lag("day").over(visits), "_first": first_day})
        .withColumn("_counts", (F.col("_row") == 1) | ~F.col("day").eqNullSafe(F.col("_before")))
    )
    return told.groupBy("entity", "day").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("net").alias("gmv"),
        count_where(refunded).alias("refunds"),
        net_where(refunded).alias("refund_cents"),
        count_where(charged_back).alias("chargebacks"),
        net_where(charged_back).alias("chargeback_cents"),
        count_where(F.col("l_linestatus") == "F").alias("on_time"),
        F.sum("quantity").alias("quantity"),
        *[net_where(F.col("o_orderpriority") == p).alias(f"pay_{m}") for m, p in METHOD_PRIORITIES.items()],
        count_where(F.col("_counts")).alias("customers"),
        count_where(F.col("_counts") & (F.col("day") == F.col("_first"))).alias("new_customers"),
    )


CELL_MEASURES = [
    "lines",
    "gmv",
    "refunds",
    "refund_cents",
    "chargebacks",
    "chargeback_cents",
    "on_time",
    "quantity",
    *[f"pay_{m}" for m in PAYMENT_METHODS],
    "customers",
    "new_customers",
]


def calendar_bounds(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """First and last ship day as scalar subqueries over one scanned column."""
    days = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return days.agg(F.min("day")).scalar(), days.agg(F.max("day")).scalar()


def densify(cells: DataFrame, entity: str, day: str, first: Column, last: Column, measures: list[str]) -> DataFrame:
    """One row per entity and calendar day, 0 on days without a cell.

    Each cell expands to itself plus the empty days up to the next cell, so no calendar
    join is needed and the rows stay partitioned by entity for the windows that follow.
    """
    per_entity = Window.partitionBy(entity).orderBy(day)
    spans = cells.select(
        "*",
        F.when(F.lag(day).over(per_entity).isNull(), first).otherwise(F.col(day)).alias("_from"),
        F.coalesce(F.date_sub(F.lead(day).over(per_entity), 1), last).alias("_to"),
    )
    return spans.select(
        "*", F.explode(F.sequence("_from", "_to")).alias("_day")
    ).select(
        entity,
        F.col("_day").alias(day),
        *[F.when(F.col("_day") == F.col(day), F.col(m)).otherwise(F.lit(0)).alias(m) for m in measures],
    )


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")


def panel(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """The daily panel.  Money columns are DECIMAL(18,2): exact, so sums do not depend on order.

    Cells move under the panel's own key and its windows run by (merchant_id, day_index), as those of
    features and labels do: the many more dense rows are then neither moved nor sorted again.
    """
    first, last = calendar_bounds(spark, sf_dir)
    cells = entity_days(spark, sf_dir, level).withColumn("merchant_id", _entity_id(level, F.col("entity")))
    if level in SPREAD_LEVELS:
        cells = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "merchant_id")
    dense = densify(cells, "merchant_id", "day", first, last, CELL_MEASURES).withColumn(
        "day_index", F.datediff("day", first).cast("long")
    )
    recent = Window.partitionBy("merchant_id").orderBy("day_index")
    net = F.col("gmv") - F.col("refund_cents") - F.col("chargeback_cents")

    def trailing_net(days: int) -> Column:
        return F.greatest(F.sum(net).over(recent.rowsBetween(-(days - 1), 0)), F.lit(0))

    with_funds = dense.withColumns(
        {"liquidity": trailing_net(LIQUIDITY_DAYS), "pending": trailing_net(SETTLEMENT_DAYS)}
    )
    lines, customers = F.col("lines"), F.col("customers")
    return with_funds.select(
        "merchant_id",
        F.col("day").alias("date"),
        "day_index",
        _money(F.col("gmv")).alias("gmv"),
        lines.alias("transaction_count"),
        ratio_or_zero(F.col("gmv") / 100, lines).alias("aov"),
        F.col("refunds").alias("refund_count"),
        _money(F.col("refund_cents")).alias("refund_amount"),
        ratio_or_zero(F.col("refunds"), lines).alias("refund_rate"),
        F.col("chargebacks").alias("chargeback_count"),
        _money(F.col("chargeback_cents")).alias("chargeback_amount"),
        ratio_or_zero(F.col("chargebacks"), lines).alias("chargeback_rate"),
        ratio_or_zero(F.col("quantity"), lines * 10).alias("fulfillment_delay_avg_days"),
        ratio_or_zero(F.col("on_time"), lines).alias("fulfillment_on_time_rate"),
        customers.alias("customer_count"),
        F.col("new_customers"),
        (customers - F.col("new_customers")).alias("returning_customers"),
        ratio_or_zero(F.col("new_customers"), customers).alias("new_customer_rate"),
        *[ratio_or_zero(F.col(f"pay_{m}"), F.col("gmv")).alias(f"pct_pay_{m}") for m in PAYMENT_METHODS],
        _money(F.col("liquidity")).alias("liquidity_balance"),
        _money(F.col("pending")).alias("pending_settlement_amount"),
    ).select(*DAILY.fieldNames())


def _signup_date() -> Column:
    return F.date_sub(F.lit("1995-01-01").cast("date"), 60 + 10 * F.col("s_nationkey"))


def merchant_signups(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """(merchant_id, signup_date): all that the feature matrix may read about an entity."""
    keys = read(spark, sf_dir, "supplier").select(_entity_key(level).alias("key"), "s_nationkey").distinct()
    return keys.select(_entity_id(level, F.col("key")).alias("merchant_id"), _signup_date().alias("signup_date"))


def merchant_dimension(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """Observable attributes only: id, archetype, tier, signup date, weekly profile."""
    suppliers = (
        read(spark, sf_dir, "supplier")
        .withColumn("merchant_id", _entity_id(level, _entity_key(level)))
        .groupBy("merchant_id", "s_nationkey")
        .agg(F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("balance"))
    )
    nations = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    located = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "merchant_id", "s_nationkey", "balance", F.col("r_name").alias("archetype")
    )
    # Terciles by rank, from running counts over distinct balances rather than one global sort.
    ranks = running_totals(
        located.groupBy("balance").agg(F.count(F.lit(1)).alias("n")), [], "balance", ["n"]
    ).select(
        "balance", F.floor(F.col("n_before") * 3 / F.col("n_total")).alias("tercile")
    )
    return located.join(ranks, "balance").select(
        "merchant_id",
        "archetype",
        F.element_at(F.array(F.lit("small"), F.lit("mid"), F.lit("large")), (F.col("tercile") + 1).cast("int")).alias(
            "business_tier"
        ),
        _signup_date().alias("signup_date"),
        F.when(F.col("s_nationkey") % 2 == 0, "weekend_heavy").otherwise("weekday_heavy").alias(
            "weekly_seasonality_profile"
        ),
    )


def merchant_baselines(daily: DataFrame) -> DataFrame:
    """Whole-history level of each entity: the ground-truth columns a model must never see."""
    txns, customers = F.sum("transaction_count"), F.sum("customer_count")
    days = F.count(F.lit(1))
    gmv = F.sum("gmv").cast("double")
    return daily.groupBy("merchant_id").agg(
        (gmv / days).alias("baseline_daily_gmv"),
        (txns / days).alias("baseline_daily_txn_count"),
        ratio_or_zero(gmv, txns).alias("baseline_aov"),
        ratio_or_zero(F.sum("refund_count"), txns).alias("baseline_refund_rate"),
        ratio_or_zero(F.sum("chargeback_count"), txns).alias("baseline_chargeback_rate"),
        F.avg("fulfillment_delay_avg_days").alias("baseline_fulfillment_delay_days"),
        F.avg("fulfillment_on_time_rate").alias("baseline_on_time_rate"),
        ratio_or_zero(F.sum("new_customers"), customers).alias("baseline_new_customer_rate"),
        *[F.avg(f"pct_pay_{m}").alias(f"baseline_pct_pay_{m}") for m in PAYMENT_METHODS],
        F.lit(0.0).alias("annual_growth_rate"),
        F.coalesce(F.stddev_samp(F.col("gmv").cast("double")) / (gmv / days), F.lit(0.0)).alias("volatility_factor"),
        F.lit(float(LIQUIDITY_DAYS)).alias("liquidity_buffer_days"),
        F.lit(SETTLEMENT_DAYS).cast("long").alias("settlement_cycle_days"),
    )


def merchants(dimension: DataFrame, daily: DataFrame) -> DataFrame:
    from tidepanel.sources.schemas import MERCHANTS

    return dimension.join(merchant_baselines(daily), "merchant_id").select(*MERCHANTS.fieldNames())


def scenario_events(features: DataFrame, last_day: Column) -> DataFrame:
    """Interval table: maximal runs of days on which a deviation signal is past the threshold."""
    signal = F.explode(
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("event_type"),
                        F.lit(category).alias("category"),
                        F.lit(affects).alias("affects"),
                        (F.col(name) * sign).alias("z"),
                    )
                    for name, (kind, category, sign, affects) in SIGNALS.items()
                ]
            ),
            lambda s: s["z"] >= SIGNAL_THRESHOLD_Z,
        )
    ).alias("signal")
    flagged = features.select(*PANEL_KEYS, signal).select(*PANEL_KEYS, "signal.*")
    episodes = runs_of(flagged, ["merchant_id", "event_type"], "day_index").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.first("category").alias("category"),
        F.first("affects").alias("affects"),
        F.max("z").alias("peak"),
    )
    days = F.datediff("end_date", "start_date") + 1
    benign = F.col("category") == "benign_growth"
    shape = F.when(days >= 3, "gradual").otherwise("sudden")
    return episodes.select(
        F.concat_ws("-", F.lit("E"), "merchant_id", F.date_format("start_date", "yyyyMMdd"), "event_type").alias("event_id"),
        "merchant_id",
        "event_type",
        "category",
        benign.alias("hard_negative"),
        shape.alias("shape"),
        "start_date",
        "end_date",
        F.least(F.date_add("end_date", RECOVERY_DAYS), last_day).alias("recovery_end_date"),
        days.cast("long").alias("duration_days"),
        F.least(F.col("peak") / 10, F.lit(1.0)).alias("severity_score"),
        "affects",
        F.concat(
            F.replace("event_type", F.lit("_"), F.lit(" ")), F.lit(" ("), shape, F.lit(" onset)")
        ).alias("description"),
    )
