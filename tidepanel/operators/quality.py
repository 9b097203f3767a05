"""Structural audits and distribution reports over a panel and its tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.numeric import count_where, is_close, no_nan, ratio_or_null
from tidepanel.functions.ordered import exact_quantiles, quantiles_from_counts
from tidepanel.sources.schemas import PAYMENT_METHODS, TABLES
from tidepanel.sources.storage import written

# The quantiles of a robust summary.
SUMMARY_QUANTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}

# Columns of the core distribution report.
CORE_COLUMNS = [
    "transaction_count",
    "gmv",
    "aov",
    "refund_count",
    "refund_rate",
    "chargeback_count",
    "chargeback_rate",
    "fulfillment_on_time_rate",
    "fulfillment_delay_avg_days",
    "new_customer_rate",
    "liquidity_balance",
    "pending_settlement_amount",
]
BEHAVIOR_COLUMNS = ["gmv", "aov", "refund_rate", "chargeback_rate", "fulfillment_on_time_rate", "new_customer_rate"]
UNIT_INTERVAL_COLUMNS = ["refund_rate", "chargeback_rate", "fulfillment_on_time_rate", "new_customer_rate"]
UNDERREPRESENTED_FRACTION = 0.7


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (keys, name, value) doubles."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value
    )


def panel_structure(daily: DataFrame) -> DataFrame:
    """One row: entities, rows, rows per entity, date range."""
    per_entity = daily.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    return per_entity.agg(
        F.count(F.lit(1)).alias("n_merchants"),
        F.sum("n").alias("n_daily_rows"),
        F.min("n").alias("min_days_per_merchant"),
        F.max("n").alias("max_days_per_merchant"),
        F.min("lo").alias("min_date"),
        F.max("hi").alias("max_date"),
    )


def gap_audit(daily: DataFrame) -> DataFrame:
    """One row per entity with flags for broken day numbering and missing dates."""
    by_number = Window.partitionBy("merchant_id").orderBy("day_index")
    by_date = Window.partitionBy("merchant_id").orderBy("date")
    first = F.min("date").over(by_date.rowsBetween(Window.unboundedPreceding, 0))
    # Numbers 0 to n - 1, and n dates on end, are those whose place in order is their distance from the first.
    placed = daily.select("merchant_id", "day_index", "date").select(
        "merchant_id",
        (F.col("day_index") == F.row_number().over(by_number) - 1).alias("numbered"),
        (F.datediff("date", first) == F.row_number().over(by_date) - 1).alias("dated"),
    )
    n = F.col("n_days")
    return placed.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("n_days"), count_where(F.col("numbered")).alias("in_number"), count_where(F.col("dated")).alias("in_date")
    ).select("merchant_id", "n_days", (F.col("in_number") != n).alias("day_index_gap"), (F.col("in_date") != n).alias("date_gap"))


def duplicate_count(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Rows beyond the first per key; null keys compare equal."""
    return (
        df.groupBy(*keys)
        .count()
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))
        .select(F.lit(table).alias("table_name"), "n_duplicates")
    )


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """Columns holding a null or NaN, with the number of such cells and the column type."""

    def missing(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return count_where(c.isNull() | F.isnan(c))
        return count_where(c.isNull())

    counted = df.agg(*[missing(f).alias(f.name) for f in df.schema])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    kind_of = F.create_map(*[x for pair in kinds.items() for x in (F.lit(pair[0]), F.lit(pair[1]))])
    return (
        counted.unpivot([], list(kinds), "column_name", "n_missing")
        .where(F.col("n_missing") > 0)
        .select(F.lit(table).alias("table_name"), "column_name", "n_missing", kind_of[F.col("column_name")].alias("data_type"))
    )


def rule_suite(daily: DataFrame) -> DataFrame:
    """(rule, n_violations) for every consistency rule, in one pass.

    The order-value and payment-mix rules apply to days with at least one transaction:
    densified days have neither.
    """
    c = F.col
    gmv, refund, chargeback = (c(x).cast("double") for x in ("gmv", "refund_amount", "chargeback_amount"))
    txn = c("transaction_count")
    active = txn >= 1
    mix = sum((c(f"pct_pay_{m}") for m in PAYMENT_METHODS[1:]), c(f"pct_pay_{PAYMENT_METHODS[0]}"))
    rules = {
        "negative_gmv": gmv < 0,
        "negative_transaction_count": txn < 1,
        "negative_refund_amount": refund < 0,
        "negative_chargeback_amount": chargeback < 0,
        "negative_liquidity_balance": c("liquidity_balance") < 0,
        "refund_amount_exceeds_gmv": refund > gmv + 1e-6,
        "refund_count_exceeds_transactions": c("refund_count") > txn,
        "chargeback_count_exceeds_transactions": c("chargeback_count") > txn,
        "chargeback_amount_exceeds_gmv_same_day": chargeback > gmv,
        "customer_split_inconsistent": c("new_customers") + c("returning_customers") != c("customer_count"),
        "aov_times_txn_not_equal_gmv": active & ~is_close(c("aov") * txn, gmv, rtol=1e-6, atol=1e-3),
        "payment_mix_not_summing_to_one": active & ~is_close(mix, F.lit(1.0), atol=1e-6),
        **{f"{r}_out_of_unit_interval": ~c(r).between(0, 1) for r in UNIT_INTERVAL_COLUMNS},
    }
    return daily.agg(*[count_where(v).alias(n) for n, v in rules.items()]).unpivot(
        [], list(rules), "rule", "n_violations"
    )


def overlap_count(events: DataFrame) -> DataFrame:
    """Intervals starting no later than the previous interval's recovery end, per entity."""
    order = Window.partitionBy("merchant_id").orderBy("start_date", "event_id")
    return (
        events.withColumn("_prev", F.lag("recovery_end_date").over(order))
        .groupBy("merchant_id")
        .agg(F.count(F.lit(1)).alias("n_events"), count_where(F.col("start_date") <= F.col("_prev")).alias("n_overlaps"))
    )


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Absolute and normalised value counts, nulls dropped."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column)).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))


def underrepresented(df: DataFrame, column: str, fraction: float = UNDERREPRESENTED_FRACTION) -> DataFrame:
    """Groups smaller than a fraction of the mean group size."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.avg("n")).scalar()
    return counts.select("value", "n", mean.alias("mean_count"), (F.col("n") < mean * fraction).alias("underrepresented"))


def grouped_medians(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, metric, median) with exact medians."""
    return exact_quantiles(long_form(df, [group], columns), [group, "metric"], "value", {"median": 0.5})


def robust_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quantiles; nulls and text dropped.

    The input is read once: distinct values with their counts are written, and everything else comes from
    them.  A group without any number keeps its row, with count 0.
    """
    keys = list(keys)
    kind = df.schema[value].dataType
    number = F.col(value).try_cast("double") if isinstance(kind, T.StringType) else F.col(value).cast("double")
    return summary_of_counts(_counted(df.select(*keys, number.alias("value")), keys), keys)


def _counted(numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, n) with NaN as null."""
    named = numbers.select(*keys, F.when(~F.isnan("value"), F.col("value")).alias("value"))
    return named.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def summary_of_counts(value_counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The robust summary from (keys, value, n) rows; null values only keep their group's row."""
    keys = list(keys)
    counts = written(value_counts, "value_counts")
    given = counts.where(F.col("value").isNotNull())
    n = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    middle = counts.groupBy(*keys).agg(
        F.sum(n).alias("count"),
        F.when(F.sum(n) > 0, F.sum(F.col("value") * F.col("n")) / F.sum(n)).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    off = F.col("value") - F.col("mean")
    spread = given.join(middle.select(*keys, "mean"), keys).groupBy(*keys).agg(
        F.when(F.sum("n") > 1, F.sqrt(F.sum(off * off * F.col("n")) / (F.sum("n") - 1))).alias("std")
    )
    quantiles = quantiles_from_counts(given, keys, SUMMARY_QUANTILES, stored=True)
    return middle.join(spread, keys, "left").join(quantiles, keys, "left").select(
        *keys, "count", "mean", "std", "min", *SUMMARY_QUANTILES, "max"
    )


def core_distributions(daily: DataFrame) -> DataFrame:
    """A robust summary per column.  The columns are written once; each is then counted by its value alone."""
    stored = written(daily.select(*[F.col(c).cast("double").alias(c) for c in CORE_COLUMNS]), "core_columns")
    counts = [_counted(stored.select(F.col(c).alias("value")), []).withColumn("metric", F.lit(c)) for c in CORE_COLUMNS]
    return summary_of_counts(reduce(DataFrame.unionByName, counts), ["metric"])


def financial_ratios(daily: DataFrame, merchants: DataFrame) -> DataFrame:
    """Summaries of chargeback, refund and pending-settlement ratios."""
    gmv = F.col("gmv").cast("double")
    with_cycle = daily.join(merchants.select("merchant_id", "settlement_cycle_days"), "merchant_id").select(
        no_nan(ratio_or_null(F.col("chargeback_amount").cast("double"), gmv)).alias("chargeback_amount_to_gmv_ratio"),
        no_nan(ratio_or_null(F.col("refund_amount").cast("double"), gmv)).alias("refund_amount_to_gmv_ratio"),
        (
            F.col("pending_settlement_amount").cast("double")
            / (F.col("settlement_cycle_days") * F.greatest(gmv, F.lit(1.0)))
        ).alias("pending_settlement_to_expected_scale_ratio"),
    )
    return robust_summary(long_form(with_cycle, [], with_cycle.columns, "ratio"), ["ratio"], "value")


def schema_conformity(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Symmetric difference of declared and actual columns, from column names alone."""
    schema = "table_name string, column_name string"
    declared = spark.createDataFrame([(t, c) for t in tables for c in TABLES[t].fieldNames()], schema)
    actual = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns], schema)
    missing = declared.exceptAll(actual).withColumn("problem", F.lit("missing"))
    extra = actual.exceptAll(declared).withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


# Substrings and names that must not occur among model features.
FORBIDDEN_SUBSTRINGS = [
    "baseline_",
    "event_type",
    "event_id",
    "severity_score",
    "hard_negative",
    "elevation_ratio",
    "future_chargeback",
    "future_transaction",
    "label_elevated",
    "archetype",
]
FORBIDDEN_NAMES = ["merchant_id", "day_index", "date", "as_of_date", "business_tier"]
# Terms that mark a label-derived column in the daily table.
LABEL_TERMS = ["future_", "elevation_ratio", "label_elevated"]


def column_audit(names: DataFrame, name: str = "column_name", substrings: Sequence[str] = tuple(FORBIDDEN_SUBSTRINGS)) -> DataFrame:
    """Flag forbidden feature names in a DataFrame of column names."""
    c = F.col(name)
    hits = F.filter(F.array(*[F.lit(s) for s in substrings]), lambda s: F.contains(c, s))
    return names.select(
        c.alias("column_name"),
        F.array_join(hits, ",").alias("matched_patterns"),
        c.isin(FORBIDDEN_NAMES).alias("forbidden_name"),
        ((F.size(hits) > 0) | c.isin(FORBIDDEN_NAMES)).alias("violation"),
    )


def assert_feature_columns(columns: Sequence[str], expected: Sequence[str] | None = None) -> None:
    """Raise on a forbidden feature name, or on any difference from the model's own column list."""
    for column in columns:
        bad = [s for s in FORBIDDEN_SUBSTRINGS if s in column]
        if bad or column in FORBIDDEN_NAMES:
            raise ValueError(f"forbidden feature column {column!r} ({', '.join(bad) or 'identifier'})")
    if expected is not None and list(columns) != list(expected):
        raise ValueError(f"feature columns differ from the model's: {list(columns)} != {list(expected)}")


def _as_text(field: T.StructField) -> Column:
    """A cell as text that any engine writes alike; fractions to six digits; a null is marked."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        c = F.round(c.cast("double") * 1_000_000).cast("long")
    return F.coalesce(c.cast("string"), F.lit("~"))


def file_digests(df: DataFrame, table: str) -> DataFrame:
    """(table_name, file, n_rows, digest_high, digest_low): order-insensitive sums of the rows' MD5 digests per source file.

    Sums of disjoint row sets add up, so a table's fingerprint follows from its files' and a changed or
    added file costs only its own reading.
    """
    row = F.md5(F.concat_ws("|", *[_as_text(f) for f in df.schema]))
    part = lambda at: F.conv(F.substring(row, at, 8), 16, 10).cast("long")
    return df.groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(part(1)).alias("digest_high"), F.sum(part(9)).alias("digest_low")
    ).select(F.lit(table).alias("table_name"), "file", "n_rows", "digest_high", "digest_low")


def merged_digests(files: DataFrame) -> DataFrame:
    """(table_name, n_rows, digest_high, digest_low, digest) per table from its files' digests."""
    sums = files.groupBy("table_name").agg(*[F.sum(c).cast("long").alias(c) for c in ("n_rows", "digest_high", "digest_low")])
    return sums.withColumn("digest", F.md5(F.concat_ws("|", "n_rows", "digest_high", "digest_low")))


def updated_digests(known: DataFrame, listing: DataFrame, read: Callable[[list[str]], DataFrame], table: str) -> DataFrame:
    """File digests with the listing's (path, length, modificationTime), reading only files that ``known`` lacks in that state.

    ``known`` is an earlier result; files that are gone lose their row.  The listing, a row per file, decides
    on the driver which paths are read.
    """
    state = ["path", "length", "modificationTime"]
    kept = known.join(listing, state, "left_semi")
    fresh = listing.join(known, state, "left_anti")
    paths = [r["path"] for r in fresh.select("path").collect()]
    if not paths:
        return kept
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    made = file_digests(read(paths), table).withColumn("_file", bare(F.col("file")))
    joined = fresh.withColumn("_file", bare(F.col("path"))).join(made, "_file", "left").drop("_file")
    filled = joined.withColumns({"table_name": F.lit(table), **{c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "digest_high", "digest_low")}})
    return kept.unionByName(filled.select(*kept.columns))
