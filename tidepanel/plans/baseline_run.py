"""The full baseline run: every model at every horizon, from frames to error analysis, resumable by stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import intervals, metrics, models, quality
from tidepanel.operators.features import feature_columns
from tidepanel.operators.metrics import LABEL
from tidepanel.plans import training
from tidepanel.plans.inputs import Dataset
from tidepanel.plans.staged import StagedRun
from tidepanel.plans.training import BY, VOLUME, role

DIMENSIONS = ["active_event_type", "active_event_category", "archetype", "volume_bucket"]
RATE_DIMENSIONS = ["active_event_type", "archetype"]


class BaselineRun:
    """Stages: frames, scored, importances, decided, then one table per report.  Each is made once per input state."""

    def __init__(self, d: Dataset, forest: dict = models.FOREST, boosting: dict = models.BOOSTING):
        self.d, self.forest, self.boosting = d, forest, boosting
        self.run = StagedRun(d.spark, d.sf_dir, f"{d.level}|{forest}|{boosting}")

    @property
    def frames(self) -> DataFrame:
        return self.run.stage("frames", lambda: training.model_frame(self.d))

    def _fit(self) -> None:
        """Fit all models once; both what they score and what they weigh is stored."""
        if self.run.complete("scored") and self.run.complete("importances"):
            return
        fitted = training.fit_all(self.frames, self.forest, self.boosting)
        self.run.stage("importances", lambda: training.ranked_importances(self.d.spark, fitted))
        self.run.stage("scored", lambda: training.score_all(self.frames, fitted).unionByName(training.baseline_scores(self.frames)))

    @property
    def importances(self) -> DataFrame:
        self._fit()
        return self.d.spark.read.parquet(f"{self.run.root}/importances")

    @property
    def decided(self) -> DataFrame:
        def make():
            self._fit()
            return training.decide(self.d.spark.read.parquet(f"{self.run.root}/scored"))

        return self.run.stage("decided", make)

    @property
    def comparison(self) -> DataFrame:
        return self.run.stage("comparison", lambda: training.compare(self.decided))

    @property
    def costs(self) -> DataFrame:
        return self.run.stage("costs", lambda: metrics.false_positive_cost(metrics.confusion(role(self.decided, "normal_test"), BY)))

    @property
    def reliability(self) -> DataFrame:
        return self.run.stage("reliability", lambda: metrics.reliability_curve(role(self.decided, "normal_test"), BY, "probability"))

    @property
    def errors(self) -> DataFrame:
        """Test rows of every model with their error class, active event and volume bucket."""

        def make():
            test = role(self.decided, "normal_test")
            median = quality.exact_quantiles(test, BY, VOLUME, {"median_volume": 0.5})
            tagged = intervals.tag_active_event(test.withColumn("date", F.col("as_of_date")), self.d.events)
            return tagged.join(median, BY).select(
                *BY, LABEL, *DIMENSIONS[:3],
                metrics.error_type(F.col("predicted"), F.col(LABEL)).alias("error_type"),
                metrics.volume_bucket(F.col(VOLUME), F.col("median_volume")).alias("volume_bucket"),
            )

        return self.run.stage("errors", make)

    @property
    def error_breakdown(self) -> DataFrame:
        return metrics.error_breakdown(self.errors, BY, DIMENSIONS)

    @property
    def error_rates(self) -> DataFrame:
        return metrics.error_rates(self.errors, BY, RATE_DIMENSIONS)

    @property
    def forecasts(self) -> DataFrame:
        return self.run.stage("forecasts", lambda: training.forecasts(self.frames, self.forest))

    @property
    def shortcuts(self) -> DataFrame:
        return self.run.stage("shortcuts", lambda: training.shortcut_verdicts(self.d.spark, role(self.frames, "train"), self.importances))

    def report(self) -> DataFrame:
        """Every result as (section, model, horizon_days, item, value); a number that is not defined is null."""
        lead = ["model", "horizon_days"]

        def long(section: str, df: DataFrame, *names: str) -> DataFrame:
            values = [f.name for f in df.schema if f.name not in (*lead, *names) and f.dataType.typeName() != "string"]
            cells = df.select(*lead, F.concat_ws("/", *names).alias("_of"), *[F.col(v).cast("double").alias(v) for v in values])
            cells = cells.unpivot([*lead, "_of"], values, "_item", "value")
            item = F.when(F.col("_of") == "", F.col("_item")).otherwise(F.concat_ws("/", "_of", "_item"))
            return cells.select(F.lit(section).alias("section"), *lead, item.alias("item"), "value")

        parts = [
            long("comparison", self.comparison),
            long("cost", self.costs.withColumn("benefit", F.format_string("benefit_%.0f", "assumed_benefit_per_true_positive")), "benefit"),
            long("reliability", self.reliability.withColumn("bin", F.format_string("bin_%02d", "bin")), "bin"),
            long("error_breakdown", self.error_breakdown, "error_type", "dimension", "value"),
            long("error_rates", self.error_rates, "error", "dimension", "value"),
            long("forecast", self.forecasts),
            long("shortcuts", self.shortcuts),
        ]
        return reduce(DataFrame.unionByName, parts)
