"""Pooled event effects, event mix, label prevalence and horizon agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numeric import count_where, ratio_or_null
from tidepanel.functions.ordered import exact_quantiles
from tidepanel.operators import windows as W
from tidepanel.sources.storage import written

EPS = 1e-9

# Bands of the growth-is-not-risk verdict and the prevalence check.
GROWTH_MIN_GMV_RATIO = 1.3
GROWTH_MAX_RISK_RATIO = 1.5
PREVALENCE_BAND = (0.05, 0.60)

EFFECT_COLUMNS = [
    "gmv_ratio_vs_baseline",
    "transaction_count_ratio_vs_baseline",
    "chargeback_rate_ratio_vs_baseline",
    "refund_rate_ratio_vs_baseline",
    "fulfillment_on_time_rate_delta_vs_baseline",
]


def _guarded(num: Column, den: Column) -> Column:
    return F.when(den > EPS, num / den)


def pooled_effects(tagged: DataFrame, merchants: DataFrame) -> DataFrame:
    """Observed over expected per active event type, pooled over all entity-days."""
    baseline = merchants.select(
        "merchant_id",
        "baseline_daily_gmv",
        "baseline_daily_txn_count",
        "baseline_chargeback_rate",
        "baseline_refund_rate",
        "baseline_on_time_rate",
        "baseline_new_customer_rate",
    )
    c, txn = F.col, F.col("transaction_count")
    # Pre-aggregate per (type, entity): the baseline columns are constant there, so they join
    # once per pair instead of once per day, and the distinct count becomes a count of rows.
    per_entity = tagged.groupBy("active_event_type", "active_event_category", "merchant_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("gmv").cast("double").alias("gmv"),
        F.sum(txn).alias("txns"),
        F.sum("chargeback_count").alias("chargebacks"),
        F.sum("refund_count").alias("refunds"),
        F.sum("fulfillment_on_time_rate").alias("on_time"),
        F.sum("new_customer_rate").alias("new_rate"),
    )
    days = F.sum("days")
    return (
        per_entity.join(baseline, "merchant_id")
        .groupBy("active_event_type")
        .agg(
            F.first("active_event_category").alias("category"),
            days.alias("n_merchant_days"),
            F.count(F.lit(1)).alias("n_distinct_merchants"),
            (F.sum("gmv") / F.sum(c("baseline_daily_gmv") * c("days"))).alias("gmv_ratio_vs_baseline"),
            (F.sum("txns") / F.sum(c("baseline_daily_txn_count") * c("days"))).alias("transaction_count_ratio_vs_baseline"),
            _guarded(F.sum("new_rate") / days, F.sum(c("baseline_new_customer_rate") * c("days")) / days).alias(
                "new_customer_rate_ratio_vs_baseline"
            ),
            _guarded(F.sum("chargebacks"), F.sum(c("baseline_chargeback_rate") * c("txns"))).alias(
                "chargeback_rate_ratio_vs_baseline"
            ),
            _guarded(F.sum("refunds"), F.sum(c("baseline_refund_rate") * c("txns"))).alias("refund_rate_ratio_vs_baseline"),
            (F.sum("on_time") / days - F.sum(c("baseline_on_time_rate") * c("days")) / days).alias(
                "fulfillment_on_time_rate_delta_vs_baseline"
            ),
        )
    )


def category_rollup(pooled: DataFrame) -> DataFrame:
    """Effects by category, weighted by entity-days."""
    weight = F.col("n_merchant_days")
    return pooled.groupBy("category").agg(
        F.sum(weight).alias("n_merchant_days"),
        *[(F.sum(F.col(x) * weight) / F.sum(weight)).alias(x) for x in EFFECT_COLUMNS],
    )


def growth_is_not_risk(rollup: DataFrame) -> DataFrame:
    """One row: do growth periods look like growth and unlike risk?"""

    def of(category: str, column: str) -> Column:
        return F.max(F.when(F.col("category") == category, F.col(column)))

    gmv, cb, refund = (
        of("benign_growth", x) for x in ("gmv_ratio_vs_baseline", "chargeback_rate_ratio_vs_baseline", "refund_rate_ratio_vs_baseline")
    )
    risk_cb = of("risk", "chargeback_rate_ratio_vs_baseline")
    return rollup.agg(
        gmv.alias("benign_gmv_ratio"),
        cb.alias("benign_chargeback_ratio"),
        refund.alias("benign_refund_ratio"),
        risk_cb.alias("risk_chargeback_ratio"),
    ).withColumn(
        "growth_ne_risk_verdict",
        (F.coalesce("benign_gmv_ratio", F.lit(0.0)) > GROWTH_MIN_GMV_RATIO)
        & (F.coalesce("benign_chargeback_ratio", F.lit(99.0)) < GROWTH_MAX_RISK_RATIO)
        & (F.coalesce("benign_refund_ratio", F.lit(99.0)) < GROWTH_MAX_RISK_RATIO)
        & (F.coalesce("risk_chargeback_ratio", F.lit(0.0)) > F.coalesce("benign_chargeback_ratio", F.lit(0.0))),
    )


def event_crosstab(events: DataFrame, merchants: DataFrame, event_types: list[str]) -> DataFrame:
    """Archetype by event type counts, 0 where absent."""
    return (
        events.join(merchants.select("merchant_id", "archetype"), "merchant_id")
        .groupBy("archetype")
        .pivot("event_type", event_types)
        .count()
        .na.fill(0)
    )


def event_concentration(events: DataFrame) -> DataFrame:
    counts = events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("merchant_id").alias("n_distinct_merchants")
    )
    return counts.withColumn(
        "events_per_merchant_that_has_it", F.bround(F.col("n_events") / F.col("n_distinct_merchants"), 2)
    )


def observed_vs_overall_share(events: DataFrame, merchants: DataFrame) -> DataFrame:
    """Share of each archetype within each event type against its share of all events."""
    located = events.join(merchants.select("merchant_id", "archetype"), "merchant_id")
    pair = located.groupBy("event_type", "archetype").agg(F.count(F.lit(1)).alias("n"))
    by_type = pair.groupBy("event_type").agg(F.sum("n").alias("n_type"), F.map_from_entries(F.collect_list(F.struct("archetype", "n"))).alias("by_archetype"))
    overall = pair.groupBy("archetype").agg(F.sum("n").alias("n_archetype"))
    total = pair.agg(F.sum("n")).scalar()
    # Archetypes and event types are fixed vocabularies: every type lists every archetype.
    archetypes = overall.agg(F.collect_list(F.struct("archetype", "n_archetype"))).scalar()
    return (
        by_type.select("event_type", "n_type", "by_archetype", F.explode(archetypes).alias("a"))
        .select(
            "event_type",
            F.col("a.archetype").alias("archetype"),
            F.bround(F.coalesce(F.try_element_at("by_archetype", F.col("a.archetype")), F.lit(0)) / F.col("n_type"), 3).alias("observed_share"),
            F.bround(F.col("a.n_archetype") / total, 3).alias("expected_share_if_uniform"),
        )
    )


def label_prevalence(labels: DataFrame, merchants: DataFrame) -> DataFrame:
    """Positive rates by horizon, with the spread over entities."""
    per_entity = labels.groupBy("horizon_days", "merchant_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label_elevated_chargeback").alias("positives")
    )
    joined = per_entity.join(merchants.select("merchant_id"), "merchant_id").withColumn("rate", F.col("positives") / F.col("rows"))
    # Totals and medians both start from here, so what built the labels runs once.
    rates = written(joined, "entity_rates")
    totals = rates.groupBy("horizon_days").agg(
        F.sum("rows").alias("usable_rows"),
        F.sum("positives").alias("positives"),
        F.min("rate").alias("min_merchant_rate"),
        F.max("rate").alias("max_merchant_rate"),
        count_where(F.col("positives") == 0).alias("n_merchants_with_zero_positives"),
        count_where(F.col("positives") == F.col("rows")).alias("n_merchants_all_positive"),
        F.count(F.lit(1)).alias("n_merchants_total"),
    )
    median = exact_quantiles(rates, ["horizon_days"], "rate", {"median_merchant_rate": 0.5})
    rate = F.col("positives") / F.col("usable_rows")
    return totals.join(median, "horizon_days", "left").select(
        "*",
        (F.col("usable_rows") - F.col("positives")).alias("negatives"),
        rate.alias("positive_rate"),
        rate.between(*PREVALENCE_BAND).alias("within_band"),
    )


def prevalence_by_archetype(labels: DataFrame, merchants: DataFrame) -> DataFrame:
    counts = labels.groupBy("horizon_days", "merchant_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label_elevated_chargeback").alias("positives")
    )
    return (
        counts.join(merchants.select("merchant_id", "archetype"), "merchant_id")
        .groupBy("horizon_days", "archetype")
        .agg(F.sum("rows").alias("rows"), F.sum("positives").alias("positives"))
        .withColumn("positive_rate", F.bround(F.col("positives") / F.col("rows"), 4))
    )


def horizon_pivot(labels: DataFrame) -> DataFrame:
    """Complete cases only: one row per entity-day with h7, h14 and h30."""
    wide = (
        labels.groupBy("merchant_id", "as_of_date")
        .pivot("horizon_days", [7, 14, 30])
        .agg(F.avg("label_elevated_chargeback"))
    )
    return wide.select(
        "merchant_id", "as_of_date", *[F.col(str(h)).alias(f"h{h}") for h in (7, 14, 30)]
    ).na.drop()


def horizon_agreement(wide: DataFrame) -> DataFrame:
    """Prevalence, conditional probabilities, Jaccard overlaps and agreement on complete cases."""
    h = {n: F.col(f"h{n}") for n in (7, 14, 30)}
    pairs = [(a, b) for a in h for b in h if a != b]
    one = {n: h[n] == 1 for n in h}
    stats = {"n_rows": F.count(F.lit(1))}
    stats |= {f"prevalence_h{n}": F.avg(h[n]) for n in h}
    stats |= {
        f"p_h{b}_given_h{a}": ratio_or_null(count_where(one[a] & one[b]), count_where(one[a])) for a, b in pairs
    }
    stats |= {
        f"jaccard_h{a}_h{b}": ratio_or_null(count_where(one[a] & one[b]), count_where(one[a] | one[b]))
        for a, b in pairs
        if a < b
    }
    stats["fraction_all_agree"] = F.avg(((h[7] == h[14]) & (h[14] == h[30])).cast("double"))
    return wide.agg(*[v.alias(n) for n, v in stats.items()])


def liquidity_trend(tagged: DataFrame, merchants: DataFrame) -> DataFrame:
    """Mean day-over-day liquidity change by active category, in units of the target buffer."""
    scale = merchants.select(
        "merchant_id", (F.col("baseline_daily_gmv") * F.col("liquidity_buffer_days")).alias("scale")
    )
    delta = W.first_difference(F.col("liquidity_balance").cast("double"))
    return (
        tagged.select("merchant_id", "day_index", "active_event_category", delta.alias("delta"))
        .join(scale, "merchant_id")
        .groupBy("active_event_category")
        .agg(F.avg(F.col("delta") / F.col("scale")).alias("mean_normalized_liquidity_change"))
    )
