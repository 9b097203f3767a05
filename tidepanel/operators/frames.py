"""Model frames: labels joined with features, entity context, split and role."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.features import feature_columns
from tidepanel.operators.splits import TEMPORAL_CUTOFF_DAY, frame_role

CONTEXT_COLUMNS = [
    "merchant_id",
    "archetype",
    "business_tier",
    "as_of_date",
    "day_index",
    "horizon_days",
    "label_elevated_chargeback",
    "future_chargeback_amount",
    "baseline_daily_chargeback_amount_trailing",
]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def one_to_one_violations(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once on either side of a join that must be one-to-one."""
    return (
        duplicate_keys(left, keys).withColumn("side", F.lit("left"))
        .unionByName(duplicate_keys(right, keys).withColumn("side", F.lit("right")))
    )


def once_per_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df``, failing where a key repeats.

    The check is a count per key inside the plan: it needs the same distribution as the join that
    follows, so it adds no exchange there and no job of its own.
    """
    copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    told = F.concat(F.lit(f"{name}: more than one row for "), F.to_json(F.struct(*keys)))
    return df.withColumn("_copies", copies).where(F.when(F.col("_copies") == 1, True).otherwise(F.raise_error(told))).drop("_copies")


def horizon_frame(
    labels: DataFrame, features: DataFrame, dimension: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Context columns plus features, all horizons stacked; filter ``horizon_days`` for one.

    Each label row (entity, day, horizon) meets at most one feature row and one entity row; a key that
    repeats on any side raises when the frame is computed.
    """
    columns = list(columns if columns is not None else feature_columns())
    days = ["merchant_id", "day_index"]
    entities = once_per_key(dimension.select("merchant_id", "archetype", "business_tier"), ["merchant_id"], "entities")
    return (
        once_per_key(labels, [*days, "horizon_days"], "labels")
        .join(once_per_key(features.select(*days, *columns), days, "features"), days)
        .join(entities, "merchant_id", "left")
        .select(*CONTEXT_COLUMNS, *columns)
    )


def with_roles(frame: DataFrame, split: DataFrame, cutoff: int = TEMPORAL_CUTOFF_DAY) -> DataFrame:
    """Add ``split`` and ``frame_role``; an entity without a split, or with two, raises when computed."""
    given = once_per_key(split.select("merchant_id", "split"), ["merchant_id"], "split")
    missing = F.raise_error(F.concat(F.lit("no split for entity "), F.coalesce(F.col("merchant_id").cast("string"), F.lit("null"))))
    return (
        frame.join(given, "merchant_id", "left")
        .withColumn("split", F.when(F.col("split").isNotNull(), F.col("split")).otherwise(missing))
        .withColumn("frame_role", frame_role(F.col("split"), F.col("day_index"), cutoff))
    )


def row_overlaps(sets: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """(left_set, right_set, n_shared) for every pair of named row sets: the size of their multiset intersection.

    Rows are compared null-safely over ``columns``.  Only digests are grouped at first; the rows themselves
    are compared exactly, and only those whose digest occurs in several sets.  Pairs without a
    common row have 0.
    """
    spark, columns = next(iter(sets.values())).sparkSession, list(columns)
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns]))
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(*columns, digest.alias("_digest"), F.lit(i).alias("_set")) for i, df in enumerate(sets.values())],
    )
    hits = tagged.groupBy("_digest").agg(F.min("_set").alias("_low"), F.max("_set").alias("_high")).where(F.col("_low") < F.col("_high"))
    counted = tagged.join(hits.select("_digest"), "_digest", "left_semi").groupBy(*columns).agg(
        *[F.count(F.when(F.col("_set") == i, 1)).alias(f"_n{i}") for i in range(len(sets))]
    )
    pairs = list(combinations(range(len(sets)), 2))
    shared = counted.agg(*[F.coalesce(F.sum(F.least(f"_n{i}", f"_n{j}")), F.lit(0)).alias(f"{i}:{j}") for i, j in pairs])
    names = spark.createDataFrame([(f"{i}:{j}", list(sets)[i], list(sets)[j]) for i, j in pairs], "pair string, left_set string, right_set string")
    return shared.unpivot([], [f"{i}:{j}" for i, j in pairs], "pair", "n_shared").join(names, "pair").select("left_set", "right_set", "n_shared")
