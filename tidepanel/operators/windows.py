"""Causal window expressions over one entity's days.

Frames are row frames: they equal day frames only on a gap-free panel, so densify first.
Every expression here uses the same (entity, day order) specification, which lets Spark
plan all of them behind a single exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.numeric import clipped, floored, ratio_floored

ENTITY, DAY = "merchant_id", "day_index"

# Trailing windows, floors and caps of the feature pipeline.
WINDOW_SHORT, WINDOW_MEDIUM, WINDOW_LONG = 7, 28, 60
STD_FLOOR = 1e-4
Z_SCORE_CLIP = 10.0
RECENCY_CAP_DAYS = 90


def entity_order() -> WindowSpec:
    return Window.partitionBy(ENTITY).orderBy(DAY)


def trailing(rows: int) -> WindowSpec:
    return entity_order().rowsBetween(-(rows - 1), 0)


def so_far() -> WindowSpec:
    return entity_order().rowsBetween(Window.unboundedPreceding, 0)


def trailing_sum(value: Column, rows: int) -> Column:
    return F.sum(value).over(trailing(rows))


def trailing_mean(value: Column, rows: int) -> Column:
    return F.avg(value).over(trailing(rows))


def trailing_std(value: Column, rows: int) -> Column:
    """Sample deviation; a single row gives 0."""
    return F.coalesce(F.stddev_samp(value.cast("double")).over(trailing(rows)), F.lit(0.0))


def trailing_rate(num: Column, den: Column, rows: int) -> Column:
    """Volume-weighted rate: sum over sum, never a mean of daily rates."""
    return ratio_floored(trailing_sum(num, rows), trailing_sum(den, rows))


def trailing_weighted_mean(value: Column, weight: Column, rows: int) -> Column:
    return ratio_floored(trailing_sum(value * weight, rows), trailing_sum(weight, rows))


def trailing_rate_unfloored(num: Column, den: Column, rows: int) -> Column:
    """Sum over sum with no denominator floor: null where the window has no volume."""
    total = trailing_sum(den, rows)
    return F.when(total != 0, trailing_sum(num, rows) / total)


def expanding_mean(value: Column) -> Column:
    return F.avg(value).over(so_far())


def expanding_std(value: Column) -> Column:
    return F.coalesce(F.stddev_samp(value).over(so_far()), F.lit(0.0))


def deviation_z(current: Column, baseline_mean: Column, baseline_std: Column) -> Column:
    """Distance from the entity's own history in floored deviations, clipped."""
    return clipped((current - baseline_mean) / floored(baseline_std, STD_FLOOR), -Z_SCORE_CLIP, Z_SCORE_CLIP)


def velocity_ratio(short: Column, long: Column) -> Column:
    return ratio_floored(short, long) - 1.0


def days_since_last_positive(count: Column, cap: int = RECENCY_CAP_DAYS) -> Column:
    last = F.last(F.when(count > 0, F.col(DAY)), ignorenulls=True).over(so_far())
    return F.least(F.coalesce(F.col(DAY) - last, F.lit(cap)), F.lit(cap))


def hhi(shares: list[Column]) -> Column:
    total = shares[0] * shares[0]
    for share in shares[1:]:
        total = total + share * share
    return total


def l1_drift(a: list[Column], b: list[Column]) -> Column:
    total = F.abs(a[0] - b[0])
    for x, y in zip(a[1:], b[1:]):
        total = total + F.abs(x - y)
    return total


def first_difference(value: Column) -> Column:
    return value - F.lag(value).over(entity_order())


def trailing_totals(
    df: DataFrame,
    measures: dict[str, Column],
    sizes: dict[str, list[int]],
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``<name>_<w>`` trailing sums as doubles for every measure and window size.

    ``extra`` holds further window expressions over ``df`` to be computed in the same pass.

    Integer and decimal measures go through running totals: the total at t minus the total
    at t-w costs O(1) per row whatever the window, and is exact because the running total
    is an integer.  Floating-point measures use a direct frame, where subtraction of running
    totals would lose digits.
    """
    probe = df.select(*[c.alias(n) for n, c in measures.items()]).schema
    scale = {f.name: _integer_scale(f.dataType) for f in probe}
    base = df.columns
    prepared = df.select(
        *base,
        *[
            (c.cast("long") if scale[n] == 1 else (c * scale[n]).cast("long") if scale[n] else c).alias(f"_{n}")
            for n, c in measures.items()
        ],
    )
    exact = [n for n in measures if scale[n]]
    extra = extra or {}
    staged = prepared.select(
        *base,
        *[c.alias(n) for n, c in extra.items()],
        *[F.sum(f"_{n}").over(so_far()).alias(f"_{n}_run") for n in exact],
        *[
            trailing_sum(F.col(f"_{n}"), w).alias(f"{n}_{w}")
            for n in measures
            if not scale[n]
            for w in sizes[n]
        ],
    )
    floats = [f"{n}_{w}" for n in measures if not scale[n] for w in sizes[n]]
    sums = []
    for n in exact:
        run = F.col(f"_{n}_run")
        for w in sizes[n]:
            units = run - F.coalesce(F.lag(run, w).over(entity_order()), F.lit(0))
            sums.append((units.cast("double") / float(scale[n])).alias(f"{n}_{w}"))
    return staged.select(*base, *extra, *floats, *sums)


def _integer_scale(kind: T.DataType) -> int | None:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return 1
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return 10**kind.scale
    return None
