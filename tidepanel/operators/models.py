"""Distributed training, scoring, calibration and artifacts: logistic models of pyspark.ml, trees of our own."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.numeric import count_where
from tidepanel.operators import trees
from tidepanel.operators.metrics import LABEL
from tidepanel.operators.quality import assert_feature_columns

SEED = 42

# Hyperparameters of the published runs.
FOREST = dict(numTrees=300, maxDepth=6, minInstancesPerNode=20, maxBins=64)
BOOSTING = dict(maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureShare=0.8, maxBins=64)
LOGISTIC_MAX_ITER = 2000


@dataclass(frozen=True)
class ClassCounts:
    negative: int
    positive: int

    @property
    def total(self) -> int:
        return self.negative + self.positive


def class_counts(frame: DataFrame, label: str = LABEL) -> ClassCounts:
    row = frame.agg(count_where(F.col(label) == 0).alias("n"), count_where(F.col(label) == 1).alias("p")).first()
    return ClassCounts(row["n"], row["p"])


def balanced_weight(counts: ClassCounts, label: str = LABEL) -> Column:
    """n / (2 * class size); global weights, as no per-bootstrap weighting exists here."""
    half = counts.total / 2
    return F.when(F.col(label) == 1, half / max(counts.positive, 1)).otherwise(half / max(counts.negative, 1))


def _prepared(frame: DataFrame, weight: Column, label: str) -> DataFrame:
    return frame.withColumns({"_weight": weight, "_label": F.col(label).cast("double")})


def _fit(frame: DataFrame, columns: Sequence[str], stages: list, weight: Column, label: str) -> PipelineModel:
    assert_feature_columns(columns)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_features")
    return Pipeline(stages=[assembler, *stages]).fit(_prepared(frame, weight, label))


def fit_logistic(frame: DataFrame, columns: Sequence[str], label: str = LABEL, c: float = 1.0) -> PipelineModel:
    """Standardised, balanced, L2-penalised; the penalty is 1 / (C * n) in the averaged objective."""
    counts = class_counts(frame, label)
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    model = LogisticRegression(
        featuresCol="_scaled", labelCol="_label", weightCol="_weight", probabilityCol="_probability", rawPredictionCol="_raw",
        predictionCol="_prediction", regParam=1.0 / (c * counts.total), elasticNetParam=0.0, standardization=False, maxIter=LOGISTIC_MAX_ITER,
    )
    return _fit(frame, columns, [scaler, model], balanced_weight(counts, label), label)


def _keys(frame: DataFrame, columns: Sequence[str]) -> list[str]:
    """What names a row for the draws: entity and day, or the features themselves."""
    return [c for c in ("merchant_id", "day_index") if c in frame.columns] or list(columns)


def training_rows(frame: DataFrame, columns: Sequence[str], by: str | None = None, label: str = LABEL) -> trees.Binned:
    """The rows of a frame binned for every tree model that learns ``label``."""
    assert_feature_columns(columns)
    return trees.prepare(frame, columns, label, _keys(frame, columns), by, FOREST["maxBins"])


def fit_forests(rows: trees.Binned, **overrides) -> dict[int, trees.TreeModel]:
    """A class forest per model of the rows, balanced within each bootstrap sample, sqrt(features) tried per split."""
    p = {**FOREST, **overrides}
    tried = max(1, int(len(rows.columns) ** 0.5))
    plan = trees.Plan(trees.CLASSES, p["numTrees"], p["maxDepth"], p["maxBins"], p["minInstancesPerNode"], tried, seed=SEED)
    return trees.fit(rows, plan)


def fit_boostings(rows: trees.Binned, **overrides) -> dict[int, trees.TreeModel]:
    """Second-order boosting of the log loss per model of the rows; positives weigh as much as negatives."""
    p = {**BOOSTING, **overrides}
    tried = max(1, int(p["featureShare"] * len(rows.columns)))
    plan = trees.Plan(trees.BOOSTING, p["maxIter"], p["maxDepth"], p["maxBins"], features=tried, rate=p["stepSize"], share=p["subsamplingRate"], seed=SEED)
    return trees.fit(rows, plan)


def fit_regression_forests(frame: DataFrame, columns: Sequence[str], target: str, by: str | None, **overrides) -> dict[int, trees.TreeModel]:
    """A forest on log1p of the target per value of ``by``, every feature tried; score with :func:`predict_amount`."""
    assert_feature_columns(columns)
    p = {**FOREST, **overrides}
    plan = trees.Plan(trees.VALUES, p["numTrees"], p["maxDepth"], p["maxBins"], p["minInstancesPerNode"], seed=SEED)
    aimed = frame.withColumn("_target", F.log1p(target))
    return trees.fit(trees.prepare(aimed, columns, "_target", _keys(frame, columns), by, p["maxBins"], trees.FIXED_POINT), plan)


def fit_forest(frame: DataFrame, columns: Sequence[str], label: str = LABEL, **overrides) -> trees.TreeModel:
    return fit_forests(training_rows(frame, columns, None, label), **overrides)[0]


def fit_boosting(frame: DataFrame, columns: Sequence[str], label: str = LABEL, **overrides) -> trees.TreeModel:
    return fit_boostings(training_rows(frame, columns, None, label), **overrides)[0]


def fit_regression_forest(frame: DataFrame, columns: Sequence[str], target: str, **overrides) -> trees.TreeModel:
    return fit_regression_forests(frame, columns, target, None, **overrides)[0]


def _public(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


Model = PipelineModel | trees.TreeModel


def predict(model: Model, frame: DataFrame, name: str = "probability") -> DataFrame:
    """Add the positive-class probability."""
    if isinstance(model, trees.TreeModel):
        return model.score(frame, name)
    return _public(model.transform(frame).withColumn(name, vector_to_array("_probability")[1]))


def predict_amount(model: trees.TreeModel, frame: DataFrame, name: str = "forecast") -> DataFrame:
    return model.score(frame, name).withColumn(name, F.expm1(name))


def importances(model: trees.TreeModel, columns: Sequence[str], name: str, spark: SparkSession) -> DataFrame:
    """(model, feature, importance, rank) by descending importance."""
    ranked = sorted(zip(columns, map(float, model.importances())), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame(
        [(name, f, v, i) for i, (f, v) in enumerate(ranked, 1)], "model string, feature string, importance double, rank int"
    )


# --- calibration -----------------------------------------------------------------------------


@dataclass(frozen=True)
class PlattScaling:
    slope: float
    intercept: float

    def apply(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-(score * self.slope + self.intercept)))


def fit_platt(scored: DataFrame, score: str = "probability", label: str = LABEL) -> PlattScaling:
    """Sigmoid on held-out scores with smoothed targets.

    A smoothed target t is one row of label 1 with weight t and one of label 0 with 1 - t.
    """
    counts = class_counts(scored, label)
    high, low = (counts.positive + 1) / (counts.positive + 2), 1 / (counts.negative + 2)
    target = F.when(F.col(label) == 1, high).otherwise(low)
    rows = scored.select(
        F.col(score).alias("_score"),
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - target).alias("w"))
            )
        ).alias("r"),
    ).select("_score", "r.y", "r.w")
    assembled = VectorAssembler(inputCols=["_score"], outputCol="x").transform(rows)
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.0, maxIter=200, tol=1e-10).fit(assembled)
    return PlattScaling(float(model.coefficients[0]), float(model.intercept))


# --- artifacts -------------------------------------------------------------------------------

ARTIFACT_TYPE = "binned_forest"


@dataclass
class Artifact:
    model: trees.TreeModel
    platt: PlattScaling
    horizon_days: int
    decision_threshold: float
    feature_columns: list[str]
    seed: int = SEED
    calibration_method: str = "sigmoid"
    fingerprints: dict = field(default_factory=dict)

    def sidecar(self) -> dict:
        return {
            "artifact_type": ARTIFACT_TYPE,
            "horizon_days": self.horizon_days,
            "decision_threshold": self.decision_threshold,
            "feature_columns_in_order": self.feature_columns,
            "calibration_method": self.calibration_method,
            "platt_slope": self.platt.slope,
            "platt_intercept": self.platt.intercept,
            "seed": self.seed,
            "input_fingerprints": json.dumps(self.fingerprints, sort_keys=True),
        }

    def score(self, frame: DataFrame) -> DataFrame:
        """Add ``probability_raw`` and the calibrated ``probability``."""
        raw = predict(self.model, frame, "probability_raw")
        return raw.withColumn("probability", self.platt.apply(F.col("probability_raw")))

    def metadata(self, spark: SparkSession) -> DataFrame:
        s = self.sidecar()
        return spark.createDataFrame(
            [(s["artifact_type"], s["horizon_days"], s["decision_threshold"], s["calibration_method"], len(self.feature_columns), s["seed"], s["input_fingerprints"])],
            "artifact_type string, horizon_days int, decision_threshold double, calibration_method string, n_features int, seed int, input_fingerprints string",
        )


def save_artifact(artifact: Artifact, path: str, spark: SparkSession) -> None:
    model = artifact.model
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    described = json.dumps({"plan": asdict(model.plan), "columns": model.columns, "edges": [e.tolist() for e in model.edges]})
    spark.createDataFrame([(described,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    spark.createDataFrame([(json.dumps(artifact.sidecar()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def load_artifact(path: str, spark: SparkSession, horizon_days: int, n_features: int) -> Artifact:
    """Load and refuse an artifact of another horizon, feature count or type."""
    meta = json.loads(spark.read.text(f"{path}/sidecar").first()["value"])
    if meta.get("artifact_type") != ARTIFACT_TYPE:
        raise ValueError(f"unexpected artifact type {meta.get('artifact_type')!r}")
    if meta["horizon_days"] != horizon_days:
        raise ValueError(f"artifact horizon {meta['horizon_days']} is not {horizon_days}")
    columns = meta["feature_columns_in_order"]
    if len(columns) != n_features:
        raise ValueError(f"artifact has {len(columns)} features, expected {n_features}")
    assert_feature_columns(columns)
    described = json.loads(spark.read.text(f"{path}/model").first()["value"])
    plan = trees.Plan(**described["plan"])
    model = trees.TreeModel(plan, described["columns"], [np.array(e, float) for e in described["edges"]], trees.Trees.empty(plan.trees, plan.nodes))
    for row in spark.read.parquet(f"{path}/trees").collect():
        model.trees.put(row["tree"], row[2:])
    if model.columns != columns:
        raise ValueError("the model's inputs differ from the recorded feature columns")
    return Artifact(
        model=model,
        platt=PlattScaling(meta["platt_slope"], meta["platt_intercept"]),
        horizon_days=meta["horizon_days"],
        decision_threshold=meta["decision_threshold"],
        feature_columns=columns,
        seed=meta["seed"],
        calibration_method=meta["calibration_method"],
        fingerprints=json.loads(meta["input_fingerprints"]),
    )
