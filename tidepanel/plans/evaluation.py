"""The threshold baseline evaluated over all horizons in one frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import frames, metrics, splits
from tidepanel.plans.inputs import Dataset
from tidepanel.sources.storage import written

BASELINE_SIGNAL = "chargeback_rate_deviation_z"
# The derived panel spans 2,500 days; as in the 180-day setting, the last third is held back.
CUTOFF_DAY = 1666


def roles_frame(d: Dataset, columns: Sequence[str]) -> DataFrame:
    """Rows with a role, with the chosen features."""
    d.store("daily")
    frame = frames.horizon_frame(d.labels, d.features, d.dimension, columns)
    return frames.with_roles(frame, splits.entity_split(d.dimension), CUTOFF_DAY).where(
        F.col("frame_role").isNotNull()
    )


def baseline_predictions(d: Dataset, columns: Sequence[str] = ()) -> DataFrame:
    """Signal as score, pseudo-probability by training range, threshold chosen on validation rows."""
    by = ["horizon_days"]
    frame = written(roles_frame(d, [BASELINE_SIGNAL, *columns]), "baseline_frame")
    fitted = metrics.grid_threshold(frame.where(F.col("frame_role") == "train"), by, BASELINE_SIGNAL)
    chosen = metrics.ranking_metrics(
        metrics.score_table(frame.where(F.col("frame_role") == "val"), by, BASELINE_SIGNAL), by
    ).select("horizon_days", F.col("best_f1_threshold").alias("decision_threshold"))
    signal = F.col(BASELINE_SIGNAL)
    predictions = (
        frame.join(fitted.select("horizon_days", "signal_min", "signal_max"), "horizon_days")
        .join(chosen, "horizon_days")
        .select(
            "*",
            signal.alias("score"),
            metrics.pseudo_probability(signal, F.col("signal_min"), F.col("signal_max")).alias("probability"),
            (signal >= F.col("decision_threshold")).alias("predicted"),
        )
    )
    return written(predictions, "baseline_predictions")
