"""Deterministic, stratified assignment of entities and rows to splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.ordered import running_totals

# Split fractions, seed and the temporal cutoff of the published runs.
SPLIT_FRACTIONS = {"train": 0.6, "val": 0.2, "test": 0.2}
SEED = 42
TEMPORAL_CUTOFF_DAY = 120


def _draw(identity: Column, seed: int) -> Column:
    """A 48-bit uniform draw that depends only on the identity and the seed."""
    return F.conv(F.substring(F.md5(F.concat(identity, F.lit(f":{seed}"))), 1, 12), 16, 10).cast("long")


def shuffled_position(df: DataFrame, strata: Sequence[str], identity: str, seed: int = SEED) -> DataFrame:
    """Add ``position`` (0-based) and ``stratum_size`` in a seeded order within each stratum.

    Positions come from running counts over the draws, so a stratum holding most of the
    rows is still spread over many tasks.
    """
    drawn = df.withColumn("_draw", _draw(F.col(identity).cast("string"), seed))
    counts = drawn.groupBy(*strata, "_draw").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts, strata, "_draw", ["n"]).drop("n")
    within = Window.partitionBy(*strata, "_draw").orderBy(identity)
    return drawn.join(placed, [*strata, "_draw"]).select(
        *df.columns,
        (F.col("n_before") + F.row_number().over(within) - 1).alias("position"),
        F.col("n_total").alias("stratum_size"),
    )


def apportion(size: Column, fractions: dict[str, float]) -> dict[str, Column]:
    """Largest-remainder counts per split; equal remainders go to the earlier name."""
    names = list(fractions)
    raw = {k: size * F.lit(fractions[k]) for k in names}
    base = {k: F.floor(raw[k]) for k in names}
    left = size - sum((base[k] for k in names[1:]), base[names[0]])
    remainder = {k: raw[k] - base[k] for k in names}

    def ahead(k: str) -> Column:
        others = [
            (remainder[o] >= remainder[k] if names.index(o) < names.index(k) else remainder[o] > remainder[k]).cast("long")
            for o in names
            if o != k
        ]
        return sum(others[1:], others[0])

    return {k: base[k] + (ahead(k) < left).cast("long") for k in names}


def entity_split(
    entities: DataFrame, stratum: str = "archetype", identity: str = "merchant_id", seed: int = SEED,
    fractions: dict[str, float] | None = None,
) -> DataFrame:
    """(identity, stratum, split): every entity once, strata apportioned by largest remainder."""
    fractions = fractions or SPLIT_FRACTIONS
    placed = shuffled_position(entities.select(identity, stratum), [stratum], identity, seed)
    counts = apportion(F.col("stratum_size"), fractions)
    assigned, upto = None, F.lit(0)
    for name, count in counts.items():
        upto = upto + count
        assigned = F.when(F.col("position") < upto, name) if assigned is None else assigned.when(F.col("position") < upto, name)
    return placed.select(identity, stratum, assigned.alias("split"))


def split_summary(split: DataFrame, stratum: str = "archetype") -> DataFrame:
    """Counts per stratum and split as columns, plus the overall row (stratum = ``all``)."""
    counts = split.groupBy(stratum).pivot("split", list(SPLIT_FRACTIONS)).count().na.fill(0)
    total = counts.agg(*[F.sum(s).alias(s) for s in SPLIT_FRACTIONS]).select(F.lit("all").alias(stratum), *SPLIT_FRACTIONS)
    n = sum((F.col(s) for s in list(SPLIT_FRACTIONS)[1:]), F.col(list(SPLIT_FRACTIONS)[0]))
    return counts.unionByName(total).select(
        "*", *[F.bround(F.col(s) / n, 3).alias(f"{s}_fraction") for s in SPLIT_FRACTIONS]
    )


def split_coverage(split: DataFrame, entities: DataFrame, identity: str = "merchant_id") -> DataFrame:
    """One row: entities without a split, splits without an entity, entities split twice."""
    ids = entities.select(identity).distinct()
    per_id = split.groupBy(identity).agg(F.count(F.lit(1)).alias("n"))
    both = ids.withColumn("known", F.lit(1)).join(per_id, identity, "full")
    return both.agg(
        F.count(F.when(F.col("n").isNull(), 1)).alias("n_unassigned"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("n_unknown"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_assigned_twice"),
    )


def frame_role(split: Column, day_index: Column, cutoff: int = TEMPORAL_CUTOFF_DAY) -> Column:
    """train / val / normal_test before the cutoff, stress_test after it; other late rows have no role."""
    early = day_index < cutoff
    return (
        F.when(early & (split == "train"), "train")
        .when(early & (split == "val"), "val")
        .when(early & (split == "test"), "normal_test")
        .when(~early & (split == "test"), "stress_test")
    )


def calibration_halves(val: DataFrame, label: str, identity: Sequence[str], seed: int = SEED, strata: Sequence[str] = ()) -> DataFrame:
    """Tag validation rows ``calibration`` or ``threshold``, half each within every label."""
    keyed = val.withColumn("_id", F.concat_ws("|", *[F.col(c).cast("string") for c in identity]))
    placed = shuffled_position(keyed, [*strata, label], "_id", seed)
    half = F.floor((F.col("stratum_size") + 1) / 2)
    return placed.select(
        *val.columns, F.when(F.col("position") < half, "calibration").otherwise("threshold").alias("half")
    )
