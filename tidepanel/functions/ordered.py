"""Exact order statistics without a single-task sort.

A rank, a percentile or a ROC curve needs running totals over all values in order.  A
window with no partition key would pull every distinct value into one task.  Instead each
key's distinct values are cut into cells at their own approximate quantiles, so that cells are
even whatever the distribution.  Cells have a bounded number (independent of the data), so the
cell totals can be accumulated by one small window, and the window over the values themselves is
partitioned by cell.  Where the cuts lie has no influence on the result.  Equal values are
collapsed by an aggregation first, so a value shared by a third of all rows is one row by the
time anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.sources.storage import written

#: Cells per key are the square of this; a value finds its cell in two steps over so many cuts.
CELL_ROOT = 16
QUANTILE_ACCURACY = 10_000


def cell_cuts(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, _cuts): approximate quantiles of each key's rows, one row per key."""
    steps = [i / CELL_ROOT**2 for i in range(1, CELL_ROOT**2)]
    return df.groupBy(*keys).agg(
        F.sort_array(F.percentile_approx(F.col(order).cast("double"), steps, QUANTILE_ACCURACY)).alias("_cuts")
    )


def order_cell(value: Column, cuts: Column) -> Column:
    """How many of the sorted ``cuts`` lie below a value, looked up first in steps and then within one."""
    v = value.cast("double")
    coarse = F.filter(cuts, lambda _, i: i % CELL_ROOT == CELL_ROOT - 1)
    step = F.size(F.filter(coarse, lambda c: c < v)) * CELL_ROOT
    return step + F.size(F.filter(F.slice(cuts, step + 1, CELL_ROOT - 1), lambda c: c < v))


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], stored: bool = False
) -> DataFrame:
    """Add ``<m>_before`` (total over strictly lower values) and ``<m>_total`` per key.

    ``df`` must hold one row per (keys, order).  It is written first, so that whatever built it runs once,
    unless ``stored`` says that it is read from a written table already.
    """
    keys = list(keys)
    df = df if stored else written(df, "counts")
    # Approximate quantiles depend on the order in which parts are merged.  Both uses below must see
    # the same cells, so the cuts, one row per key, are written too.
    cuts = written(cell_cuts(df, keys, order), "cuts")
    # Without keys the one row of cuts is a scalar; with keys Spark decides how to join one row per key.
    given = df.join(cuts, keys) if keys else df.withColumn("_cuts", cuts.scalar())
    celled = given.withColumn("_cell", order_cell(F.col(order), F.col("_cuts"))).drop("_cuts")
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = by_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        celled.groupBy(*keys, "_cell")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *keys,
            "_cell",
            *[F.coalesce(F.sum(m).over(below), F.lit(0)).alias(f"_{m}_off") for m in measures],
            *[F.sum(m).over(by_key).alias(f"{m}_total") for m in measures],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = celled.join(offsets, [*keys, "_cell"])
    return joined.select(
        *[c for c in df.columns],
        *[
            (F.col(f"_{m}_off") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_before")
            for m in measures
        ],
        *[f"{m}_total" for m in measures],
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n) with nulls and NaN dropped."""
    v = F.col(value)
    return (
        df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
        .groupBy(*keys, v.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles_from_counts(
    counts: DataFrame, keys: Sequence[str], probabilities: dict[str, float], stored: bool = False
) -> DataFrame:
    """Linear-interpolation quantiles, one column per name, from (keys, value, n) rows."""
    keys = list(keys)
    ranked = running_totals(counts, keys, "value", ["n"], stored)
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("n_total") - 1).cast("double")
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(holds, F.col("value").cast("double"))).alias(f"_{name}_{side}"))
    out = ranked.groupBy(*keys).agg(F.max("n_total").alias("_n"), *picks)
    cols = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return out.select(*keys, *cols)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact interpolating quantiles per key; a key whose values are all null has no row."""
    return quantiles_from_counts(value_counts(df, keys, value), keys, probabilities)
