"""Nested context documents for downstream consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import attribution, decisions
from tidepanel.operators.features import manifest
from tidepanel.operators.intervals import interval_days
from tidepanel.operators.models import Artifact
from tidepanel.plans.inputs import Dataset

# Provenance tag of every section.
PROVENANCE = {
    "merchant": "observed",
    "observed_state": "observed",
    "risk": "modeled",
    "exposure": "derived",
    "liquidity": "derived",
    "data_quality": "derived",
    "drivers": "modeled",
    "interventions": "derived",
    "simulation": "modeled",
    "incident": "modeled",
}


def incident_sections(nested: DataFrame) -> DataFrame:
    """(merchant_id, date, incident): on each day of its window, the incident that was detected last."""
    days = interval_days(nested.select("*", "window.start_date", "window.recovery_end_date"), "start_date", "recovery_end_date")
    section = F.struct(
        "incident_id", "event_type", "status", "priority", "priority_reasons", "detected_date",
        F.col("reason_code.label").alias("reason"), F.col("evidence.readiness_status").alias("readiness_status"),
        F.col("evidence.missing_evidence").alias("missing_evidence"), "estimated_case_count", "workflow_stage",
    )
    return days.groupBy("merchant_id", "date").agg(F.max_by(section, F.struct("detected_date", "incident_id")).alias("incident"))


def simulation_sections(simulated: DataFrame) -> DataFrame:
    """(merchant_id, date, simulation): the result with the largest request id of each entity-day."""
    section = F.struct(*[c for c in simulated.columns if c not in ("merchant_id", "date")])
    return simulated.groupBy("merchant_id", "date").agg(F.max_by(section, F.col("request_id")).alias("simulation"))


def context_documents(
    d: Dataset, artifact: Artifact, attributed: DataFrame, simulated: DataFrame | None = None, incidents: DataFrame | None = None
) -> DataFrame:
    """(merchant_id, date, document json, provenance map, limitations) for each attributed row.

    ``simulated`` (output of ``decisions.simulate``) and ``incidents`` (nested rows) fill their sections on the
    days they concern; a section without content is absent.
    """
    keys = ["merchant_id", "date"]
    listed = attribution.described(attribution.drivers(attributed, artifact.feature_columns, top_k=5), artifact.feature_columns, manifest())
    explained = listed.select(
        "merchant_id",
        F.col("as_of_date").alias("date"),
        F.struct(
            "probability", "probability_raw", decisions.risk_state(F.col("probability"), artifact.decision_threshold).alias("risk_state"),
            F.lit(artifact.decision_threshold).alias("decision_threshold"), F.lit(artifact.horizon_days).alias("horizon_days"),
        ).alias("risk"),
        F.concat("top_positive", "top_negative").alias("drivers"),
    )
    group_of = {row["name"]: row["group"] for row in manifest()}
    elevating = attribution.elevating_groups(
        attributed.withColumnRenamed("as_of_date", "date"), artifact.feature_columns, group_of, keys
    )
    days = attributed.select("merchant_id", F.col("as_of_date").alias("date"))
    features = d.features.join(days, keys, "left_semi")
    actions = (
        decisions.recommendations(features, elevating)
        .groupBy(*keys)
        # At most one entry per rule.
        .agg(F.array_sort(F.collect_list(F.struct("priority_rank", "intervention_id", "title", "priority", "reason"))).alias("interventions"))
    )
    exposure = decisions.exposure_estimate(d.daily, artifact.horizon_days).select(
        *keys,
        F.struct("exposure").alias("exposure"),
        F.struct(
            "available_liquidity", decisions.liquidity_stress(F.col("exposure"), F.col("available_liquidity")).alias("liquidity_stress")
        ).alias("liquidity"),
    )
    observed = d.daily.select(
        *keys, F.struct("gmv", "transaction_count", "chargeback_rate", "refund_rate", "fulfillment_on_time_rate").alias("observed_state")
    )
    quality = decisions.confidence(features, artifact.feature_columns).select(
        *keys, F.struct("confidence_level", "history_days", "feature_coverage_status", "reasons").alias("data_quality")
    )
    merchant = d.dimension.select("merchant_id", F.struct("archetype", "business_tier", "signup_date").alias("merchant"))
    joined = explained
    for part in (observed, exposure, quality):
        joined = joined.join(part, keys)
    joined = joined.join(actions, keys, "left").join(merchant, "merchant_id")
    extra = {
        "simulation": None if simulated is None else simulation_sections(simulated),
        "incident": None if incidents is None else incident_sections(incidents),
    }
    for name, part in extra.items():
        joined = joined.withColumn(name, F.lit(None).cast("struct<none:string>")) if part is None else joined.join(part, keys, "left")
    sections = list(PROVENANCE)
    present = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(s) for s in sections]),
            F.array(*[F.when(F.col(s).isNotNull(), F.lit(p)) for s, p in PROVENANCE.items()]),
        ),
        lambda _, tag: tag.isNotNull(),
    )
    limitations = F.array_compact(
        F.array(
            F.lit("Scores come from a synthetic benchmark and are not validated on real data."),
            F.lit("The confidence level is a fixed policy, not a statistical interval."),
            F.when(F.col("interventions").isNotNull(), "Recommendations report observed deviations and claim no causal effect."),
            F.when(F.col("simulation").isNotNull(), "A simulation re-scores one day with changed inputs and holds all others fixed."),
            F.when(F.col("incident").isNotNull(), "An incident is a modelled reading of a synthetic scenario; its evidence list is a checklist, not advice."),
        )
    )
    return joined.select(
        *keys, F.to_json(F.struct(*sections)).alias("document"), present.alias("provenance"), limitations.alias("limitations")
    )
