"""Structure, distribution, effect, label and leakage audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidepanel.functions.numeric import fixed
from tidepanel.operators import effects, intervals, metrics, quality
from tidepanel.operators import windows as W
from tidepanel.operators.features import feature_columns, manifest_df
from tidepanel.plans.registry import as_double, query, rounded
from tidepanel.sources.schemas import TABLES
from tidepanel.sources.storage import written

EVENT_TYPES = [
    "chargeback_deterioration",
    "refund_shock",
    "fulfillment_degradation",
    "customer_mix_shift",
    "festival_growth",
]


def union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("panel_structure")
def _(d):
    return quality.panel_structure(d.daily)


@query("gap_audit")
def _(d):
    return quality.gap_audit(d.daily)


@query("gap_audit_supplier", "supplier")
def _(d):
    return quality.gap_audit(d.daily)


@query("duplicate_counts")
def _(d):
    d.store("daily")
    return union(
        [
            quality.duplicate_count(d.dimension, ["merchant_id"], "merchants"),
            quality.duplicate_count(d.daily, ["merchant_id", "date"], "daily_observations"),
            quality.duplicate_count(d.events, ["merchant_id", "start_date"], "events"),
            quality.duplicate_count(d.labels, ["merchant_id", "as_of_date", "horizon_days"], "labels"),
        ]
    )


@query("null_counts")
def _(d):
    d.store("daily")
    # The pivoted label table is the one derived table with gaps: late days lack long horizons.
    wide = d.labels.groupBy("merchant_id", "as_of_date").pivot("horizon_days", [7, 14, 30]).agg(
        F.max("label_elevated_chargeback")
    )
    return union([quality.null_counts(d.daily, "daily_observations"), quality.null_counts(wide, "labels_wide")])


@query("rule_suite")
def _(d):
    return quality.rule_suite(d.daily)


@query("event_overlaps")
def _(d):
    return quality.overlap_count(d.events)


@query("schema_conformity")
def _(d):
    # The dimension lacks the ground-truth columns of the merchants contract: each is reported, next to
    # the size of the table it is missing from.  Names alone say which tables need counting.
    built = {"daily_observations": d.daily, "labels": d.labels, "events": d.events, "merchants": d.dimension}
    unlike = {t: df for t, df in built.items() if set(df.columns) != set(TABLES[t].fieldNames())}
    sizes = union([df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(t)) for t, df in unlike.items()])
    return quality.schema_conformity(built, d.spark).join(sizes, "table_name")


@query("feature_column_audit")
def _(d):
    d.store("daily")
    counted = []
    for df in (d.features, d.labels):
        names = [c for c in df.columns if c not in ("merchant_id", "day_index")]
        counted.append(df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column_name", "n_values"))
    filled = union(counted)
    return quality.column_audit(filled).join(filled, "column_name")


#: The given tables that panels, and hence models, are built from.
INPUTS = ["nation", "customer", "supplier", "orders", "lineitem"]


def input_digests(d):
    """Digests of the input tables' files."""
    return union([quality.file_digests(d.spark.read.parquet(f"{d.sf_dir}/{t}.parquet"), t) for t in INPUTS])


@query("table_fingerprints")
def _(d):
    return quality.merged_digests(input_digests(d))


@query("feature_manifest")
def _(d):
    # Joined to the realised matrix so that the manifest reports what was built.
    filled = d.features.agg(*[F.count(c).alias(c) for c in feature_columns()]).unpivot([], feature_columns(), "name", "n_values")
    return manifest_df(d.spark).join(filled, "name").select(
        "name", "group", "window", "kind", "leakage_status", "n_values"
    )


@query("dataset_manifest")
def _(d):
    d.store("daily")
    counts = union(
        [
            d.daily.agg(F.count(F.lit(1)).alias("n_rows"), F.max("date").alias("max_date")).withColumn("table_name", F.lit("daily_observations")),
            d.labels.agg(F.count(F.lit(1)).alias("n_rows"), F.max("as_of_date").alias("max_date")).withColumn("table_name", F.lit("labels")),
            d.events.agg(F.count(F.lit(1)).alias("n_rows"), F.max("end_date").alias("max_date")).withColumn("table_name", F.lit("events")),
        ]
    )
    return counts.select("table_name", "n_rows", "max_date")


@query("event_category_counts")
def _(d):
    return rounded(quality.value_share(d.events, "event_type"))


@query("archetype_counts", "supplier")
def _(d):
    return rounded(quality.underrepresented(d.dimension, "archetype"))


@query("archetype_medians")
def _(d):
    located = d.daily.join(d.dimension.select("merchant_id", "archetype"), "merchant_id")
    return rounded(quality.grouped_medians(located, "archetype", quality.BEHAVIOR_COLUMNS))


@query("core_distributions")
def _(d):
    return rounded(quality.core_distributions(d.daily))


@query("core_distributions_supplier", "supplier")
def _(d):
    return rounded(quality.core_distributions(d.daily))


@query("financial_ratios")
def _(d):
    d.store("daily")
    return rounded(quality.financial_ratios(d.daily, d.merchants))


@query("tagged_days")
def _(d):
    d.store("daily")
    tagged = intervals.tag_active_event(d.daily.select("merchant_id", "date", "day_index"), d.events)
    return tagged.select("merchant_id", "date", "active_event_type", "active_event_category")


@query("pooled_effects")
def _(d):
    d.store("daily")
    return rounded(effects.pooled_effects(intervals.tag_active_event(d.daily, d.events), d.merchants))


@query("effects_by_category")
def _(d):
    d.store("daily")
    pooled = effects.pooled_effects(intervals.tag_active_event(d.daily, d.events), d.merchants)
    return rounded(effects.category_rollup(pooled))


@query("growth_is_not_risk")
def _(d):
    d.store("daily")
    pooled = effects.pooled_effects(intervals.tag_active_event(d.daily, d.events), d.merchants)
    return rounded(effects.growth_is_not_risk(effects.category_rollup(pooled)))


@query("event_duration_summary")
def _(d):
    return rounded(quality.robust_summary(d.events, ["event_type"], "duration_days"))


@query("event_severity_summary")
def _(d):
    return rounded(quality.robust_summary(d.events, ["event_type"], "severity_score"))


@query("event_archetype_crosstab")
def _(d):
    return effects.event_crosstab(d.events, d.dimension, EVENT_TYPES)


@query("event_concentration")
def _(d):
    return effects.event_concentration(d.events)


@query("event_archetype_shares")
def _(d):
    return effects.observed_vs_overall_share(d.events, d.dimension)


@query("fulfillment_events_by_archetype_membership")
def _(d):
    located = d.events.join(d.dimension.select("merchant_id", "archetype", "business_tier"), "merchant_id")
    chosen = (
        (F.col("event_type") == "fulfillment_degradation")
        & F.col("archetype").isin("ASIA", "EUROPE")
        & F.col("business_tier").isin("mid", "large")
    )
    return located.where(chosen).groupBy("archetype", "business_tier").agg(F.count(F.lit(1)).alias("n_events"))


@query("label_prevalence")
def _(d):
    return rounded(effects.label_prevalence(d.labels, d.dimension))


@query("label_prevalence_supplier", "supplier")
def _(d):
    return rounded(effects.label_prevalence(d.labels, d.dimension))


@query("label_prevalence_by_archetype")
def _(d):
    return effects.prevalence_by_archetype(d.labels, d.dimension)


@query("horizon_pivot")
def _(d):
    return effects.horizon_pivot(d.labels)


@query("horizon_agreement")
def _(d):
    return rounded(effects.horizon_agreement(effects.horizon_pivot(d.labels)))


@query("liquidity_trend_by_category")
def _(d):
    d.store("daily")
    return rounded(effects.liquidity_trend(intervals.tag_active_event(d.daily, d.events), d.merchants))


@query("event_aligned_rates")
def _(d):
    d.store("daily")
    return rounded(intervals.mean_rate_by_offset(intervals.aligned_chargeback_rate(d.daily, d.events)))


@query("uplift_detection")
def _(d):
    d.store("daily")
    found = intervals.uplift_detection(intervals.aligned_chargeback_rate(d.daily, d.events))
    return rounded(as_double(found, "detection_offset_days"))


@query("warning_structure")
def _(d):
    d.store("daily")
    found = intervals.uplift_detection(intervals.aligned_chargeback_rate(d.daily, d.events))
    return rounded(intervals.warning_structure(written(found, "detections")))


@query("event_window_aggregates")
def _(d):
    d.store("daily")
    return rounded(intervals.event_window_aggregates(d.daily, d.events))


@query("leakage_auc_baseline_rate")
def _(d):
    d.store("daily")
    joined = d.labels.join(d.merchants.select("merchant_id", "baseline_chargeback_rate"), "merchant_id")
    return rounded(metrics.roc_auc(joined, ["horizon_days"], "baseline_chargeback_rate"))


@query("leakage_auc_risk_day")
def _(d):
    d.store("daily")
    tagged = intervals.tag_active_event(d.daily.select("merchant_id", "date", "day_index"), d.events)
    flags = tagged.select("merchant_id", "day_index", (F.col("active_event_category") == "risk").cast("double").alias("is_risk_day"))
    return rounded(metrics.roc_auc(d.labels.join(flags, ["merchant_id", "day_index"]), ["horizon_days"], "is_risk_day"))


def _difficulty_frame(d):
    rate = W.trailing_rate_unfloored(F.col("chargeback_count"), F.col("transaction_count"), 28)
    gmv = F.col("gmv").cast("double")
    context = d.daily.select(
        "merchant_id",
        "day_index",
        "chargeback_rate",
        gmv.alias("gmv"),
        rate.alias("trailing_chargeback_rate_28d"),
        # Rounded so that ties do not hang on the last bit of a floating-point mean.
        fixed(W.trailing_mean(gmv, 28), 4).alias("trailing_gmv_28d_mean"),
    )
    return d.labels.join(context, ["merchant_id", "day_index"], "left")


CAUSAL = ["trailing_chargeback_rate_28d", "trailing_gmv_28d_mean"]


def _difficulty(d):
    d.store("daily")
    columns = ["chargeback_rate", "gmv", *CAUSAL]
    long = quality.long_form(_difficulty_frame(d), ["horizon_days", "label_elevated_chargeback"], columns, "feature")
    return metrics.roc_auc(long, ["horizon_days", "feature"], "value")


@query("difficulty_auc")
def _(d):
    return rounded(_difficulty(d))


@query("difficulty_assessment")
def _(d):
    return rounded(metrics.difficulty_assessment(_difficulty(d), CAUSAL))


@query("threshold_boundary_share")
def _(d):
    t = 1.75
    near = F.abs(F.col("elevation_ratio_amount") - t) < metrics.BOUNDARY_FRACTION * t
    return rounded(d.labels.groupBy("horizon_days").agg(F.avg(near.cast("double")).alias("near_boundary_fraction")))


@query("archetype_bias")
def _(d):
    joined = d.labels.join(d.dimension.select("merchant_id", "archetype"), "merchant_id")
    # The encoding is a function of the group, so group counts are all the AUC needs.
    # At most one row per horizon and archetype.
    groups = joined.groupBy("horizon_days", "archetype").agg(
        F.avg("label_elevated_chargeback").alias("rate"),
        F.sum("label_elevated_chargeback").alias("pos"),
        F.sum(1 - F.col("label_elevated_chargeback")).alias("neg"),
    )
    table = metrics.running_totals(
        groups.groupBy("horizon_days", F.col("rate").alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")),
        ["horizon_days"],
        "score",
        ["pos", "neg"],
    )
    spread = groups.groupBy("horizon_days").agg(
        (F.max("rate") / F.greatest(F.min("rate"), F.lit(1e-9))).alias("max_over_min_ratio")
    )
    auc = metrics.ranking_metrics(table, ["horizon_days"]).select("horizon_days", F.col("roc_auc").alias("mean_encoded_auc"))
    return rounded(
        spread.join(auc, "horizon_days").withColumn("meaningful_shortcut", F.col("mean_encoded_auc") > 0.65)
    )
