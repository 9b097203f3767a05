"""Decision tables over all entity-days: exposure, stress, confidence, scenarios, incidents."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.operators import windows as W
from tidepanel.operators.intervals import detect_within_window, event_window_aggregates
from tidepanel.sources.schemas import PANEL_KEYS

EXPOSURE_WINDOW_DAYS = 28
HISTORY_FULL_DAYS, HISTORY_PARTIAL_DAYS = W.WINDOW_LONG, W.WINDOW_MEDIUM
SUPPORTED_HORIZONS = [30]
MIN_PROBABILITY_FLOOR = 1e-4
STRESS_RED, STRESS_AMBER = 1.0, 0.5


# --- risk, exposure, liquidity ---------------------------------------------------------------


def exposure_estimate(daily: DataFrame, horizon_days: int) -> DataFrame:
    """Trailing mean daily chargeback amount extrapolated flat over the horizon."""
    measures = {"amount": F.col("chargeback_amount")}
    totals = W.trailing_totals(
        daily.select(*PANEL_KEYS, "chargeback_amount", "liquidity_balance"), measures, {"amount": [EXPOSURE_WINDOW_DAYS]}
    )
    days = F.least(F.row_number().over(W.entity_order()), F.lit(EXPOSURE_WINDOW_DAYS))
    return totals.select(
        *PANEL_KEYS,
        F.col("liquidity_balance").cast("double").alias("available_liquidity"),
        (F.col(f"amount_{EXPOSURE_WINDOW_DAYS}") / days * horizon_days).alias("exposure"),
    )


def liquidity_stress(exposure: Column, liquidity: Column) -> Column:
    """Exposure over liquidity; null without an exposure or without positive liquidity."""
    return F.when(liquidity > 0, exposure / liquidity)


def stress_note(exposure: Column, liquidity: Column) -> Column:
    return (
        F.when(exposure.isNull(), "no exposure estimate")
        .when(~(liquidity > 0) | liquidity.isNull(), "liquidity is zero or negative")
        .otherwise("exposure / liquidity")
    )


def stress_band(stress: Column) -> Column:
    return F.when(stress >= STRESS_RED, "red").when(stress >= STRESS_AMBER, "amber").when(stress.isNotNull(), "ok")


def risk_state(probability: Column, threshold: Column | float) -> Column:
    return F.when(probability >= threshold, "elevated").otherwise("normal")


def reject_unsupported_horizons(requests: DataFrame, horizon: str = "horizon_days") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether a model exists for the horizon."""
    ok = F.coalesce(F.col(horizon).isin(SUPPORTED_HORIZONS), F.lit(False))
    return requests.where(ok), requests.where(~ok)


# --- confidence ------------------------------------------------------------------------------


def missing_features(columns: Sequence[str]) -> Column:
    """Names of the null or NaN feature columns of a row."""
    return F.array_compact(
        F.array(*[F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in columns])
    )


def confidence(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Deterministic confidence level with its reasons, per entity-day."""
    n, total = F.col("history_days"), len(columns)
    incomplete = F.size("missing_features") > 0
    level = (
        F.when(incomplete, "limited")
        .when(n >= HISTORY_FULL_DAYS, "high")
        .when(n >= HISTORY_PARTIAL_DAYS, "medium")
        .otherwise("limited")
    )
    complete = F.lit(f"All {total} input features are present.")
    reasons = (
        F.when(
            incomplete,
            F.array(F.concat(F.size("missing_features").cast("string"), F.lit(f" of {total} input features are missing."))),
        )
        .when(
            n >= HISTORY_FULL_DAYS,
            F.array(F.concat(n.cast("string"), F.lit(f" days of history cover the longest window ({HISTORY_FULL_DAYS} days).")), complete),
        )
        .when(
            n >= HISTORY_PARTIAL_DAYS,
            F.array(
                F.concat(n.cast("string"), F.lit(f" days of history cover the {HISTORY_PARTIAL_DAYS}-day windows only.")), complete
            ),
        )
        .otherwise(
            F.array(F.concat(F.lit("Only "), n.cast("string"), F.lit(f" days of history, short of the {HISTORY_PARTIAL_DAYS}-day windows.")))
        )
    )
    return (
        features.select(*PANEL_KEYS, (F.col("day_index") + 1).alias("history_days"), missing_features(columns).alias("missing_features"))
        .select(
            "*",
            F.when(incomplete, "incomplete").otherwise("complete").alias("feature_coverage_status"),
            level.alias("confidence_level"),
            reasons.alias("reasons"),
        )
    )


# --- scenario controls -----------------------------------------------------------------------

# Control -> (feature group, label); every control is the feature of the same name.
CONTROLS = {
    "refund_rate_28d": ("refund_behavior", "Refund rate (trailing 28 days)"),
    "fulfillment_on_time_rate_28d": ("fulfillment", "On-time fulfillment rate (trailing 28 days)"),
    "new_customer_rate_28d": ("customer_mix", "New-customer share (trailing 28 days)"),
}

# Control -> (deviation feature, direction, title) of the three review rules.
RULES = {
    "refund_rate_28d": ("refund_rate_deviation_z", "high_is_bad", "Review refund pressure"),
    "fulfillment_on_time_rate_28d": ("fulfillment_on_time_rate_deviation_z", "low_is_bad", "Review fulfillment reliability"),
    "new_customer_rate_28d": ("new_customer_rate_deviation_z", "high_is_bad", "Review customer-mix shift"),
}
RELEVANCE_Z_THRESHOLD = 2.0


def control_bounds(features: DataFrame) -> DataFrame:
    """(control_id, min_value, max_value): the observed range, one row per control."""
    return (
        features.agg(
            *[f(c).alias(f"{c}:{n}") for c in CONTROLS for n, f in (("lo", F.min), ("hi", F.max))]
        )
        .select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("control_id"),
                            F.col(f"`{c}:lo`").alias("min_value"),
                            F.col(f"`{c}:hi`").alias("max_value"),
                        )
                        for c in CONTROLS
                    ]
                )
            ).alias("b")
        )
        .select("b.*")
    )


def list_controls(features: DataFrame) -> DataFrame:
    """Controls with their bounds and current value, per entity-day."""
    current = features.select(*PANEL_KEYS, *CONTROLS).unpivot(PANEL_KEYS, list(CONTROLS), "control_id", "baseline_value")
    group = F.create_map(*[x for c, (g, _) in CONTROLS.items() for x in (F.lit(c), F.lit(g))])
    # Three rows, one per control.
    return current.join(F.broadcast(control_bounds(features)), "control_id").withColumn("group", group[F.col("control_id")])


def changed_controls(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Drop overrides equal to the current value, so only real changes are submitted."""
    current = features.select("merchant_id", "date", *[F.col(c).alias(f"_now_{c}") for c in CONTROLS])
    return requests.join(current, ["merchant_id", "date"], "left").select(
        *[
            F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_now_{c}")), F.col(c)).alias(c) if c in CONTROLS else F.col(c)
            for c in requests.columns
        ]
    )


def _request_error(
    horizon: Column, controls: dict[str, Column], features: DataFrame, entity_known: Column, day_known: Column
) -> Column:
    """The first rule that a scenario breaks; bounds come from scalar subqueries over one aggregate."""
    extremes = features.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in CONTROLS])
    none_set = F.lit(True)
    out_of_range = []
    for c, value in controls.items():
        bounds = extremes.select(c).scalar()
        none_set = none_set & value.isNull()
        out_of_range.append(F.when(~value.between(bounds["lo"], bounds["hi"]), F.lit(c)))
    bad = F.array_compact(F.array(*out_of_range))
    return (
        F.when(~F.coalesce(horizon.isin(SUPPORTED_HORIZONS), F.lit(False)), "unsupported_horizon")
        .when(none_set, "no_intervention")
        .when(~entity_known, "merchant_not_found")
        .when(~day_known, "date_not_available")
        .when(F.size(bad) > 0, F.concat(F.lit("out_of_range:"), F.array_join(bad, ",")))
    )


def validate_requests(requests: DataFrame, features: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Add ``error``: null for a valid scenario request, which :func:`simulate` then has a row for.

    Entities are known if ``dimension`` lists them (without one, if they have features); a date is
    available if the entity has features on it.
    """
    listed = (features if dimension is None else dimension).select("merchant_id", F.lit(True).alias("_known")).distinct()
    days = features.select("merchant_id", "date", F.lit(True).alias("_day"))
    found = requests.join(days, ["merchant_id", "date"], "left").join(listed, "merchant_id", "left")
    error = _request_error(
        F.col("horizon_days"), {c: F.col(c) for c in CONTROLS}, features, F.col("_known").isNotNull(), F.col("_day").isNotNull()
    )
    return found.withColumn("error", error).select(*requests.columns, "error")


def relative_change(current: Column, simulated: Column) -> Column:
    return F.when(current != 0, (simulated - current) / current)


Scorer = Callable[[DataFrame], DataFrame]


def simulate(
    requests: DataFrame,
    features: DataFrame,
    exposures: DataFrame,
    columns: Sequence[str],
    scorer: Scorer,
    threshold: float,
    request_id: str = "request_id",
) -> DataFrame:
    """Re-score each valid request with its overrides, everything else held fixed.

    The current and the changed row of a request are two variants of one frame, scored in
    one pass; ``scorer`` adds ``probability`` to a frame with the feature columns.
    """
    asked = requests.select(request_id, "merchant_id", "date", *[F.col(c).alias(f"_to_{c}") for c in CONTROLS])
    base = asked.join(features.select("merchant_id", "date", *columns), ["merchant_id", "date"])
    variants = base.withColumn("variant", F.explode(F.array(F.lit("current"), F.lit("simulated"))))
    overridden = variants.select(
        request_id,
        "merchant_id",
        "date",
        "variant",
        *[
            F.when((F.col("variant") == "simulated") & F.col(f"_to_{c}").isNotNull(), F.col(f"_to_{c}")).otherwise(F.col(c)).alias(c)
            if c in CONTROLS
            else F.col(c)
            for c in columns
        ],
    )
    p = F.col("probability")
    pairs = (
        scorer(overridden)
        .groupBy(request_id, "merchant_id", "date")
        .agg(
            F.max(F.when(F.col("variant") == "current", p)).alias("current_probability"),
            F.max(F.when(F.col("variant") == "simulated", p)).alias("simulated_probability"),
        )
    )
    with_exposure = pairs.join(
        exposures.select("merchant_id", "date", F.col("exposure").alias("exposure_current"), "available_liquidity"),
        ["merchant_id", "date"],
    ).withColumn(
        "exposure_simulated",
        F.col("exposure_current")
        * (F.col("simulated_probability") / F.greatest(F.col("current_probability"), F.lit(MIN_PROBABILITY_FLOOR))),
    )
    liquidity = F.col("available_liquidity")
    with_stress = with_exposure.withColumns(
        {
            "stress_current": liquidity_stress(F.col("exposure_current"), liquidity),
            "stress_simulated": liquidity_stress(F.col("exposure_simulated"), liquidity),
        }
    )
    deltas = {}
    for name, a, b in (
        ("probability", "current_probability", "simulated_probability"),
        ("exposure", "exposure_current", "exposure_simulated"),
        ("stress", "stress_current", "stress_simulated"),
    ):
        deltas[f"{name}_delta"] = F.col(b) - F.col(a)
        deltas[f"{name}_delta_relative"] = relative_change(F.col(a), F.col(b))
    return with_stress.withColumns(
        {
            "current_state": risk_state(F.col("current_probability"), threshold),
            "simulated_state": risk_state(F.col("simulated_probability"), threshold),
            **deltas,
        }
    )


# --- recommendations -------------------------------------------------------------------------


def signed_badness(z: Column, direction: Column) -> Column:
    return F.when(direction == "high_is_bad", z).otherwise(-z)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """High before medium, then larger badness, then control id."""
    order = Window.partitionBy("merchant_id", "date").orderBy(
        (F.col("priority") != "high").cast("int"), F.desc("badness"), "control_id"
    )
    return candidates.withColumn("priority_rank", F.row_number().over(order))


def recommendations(features: DataFrame, elevating_groups: DataFrame | None = None) -> DataFrame:
    """Controls that deviate badly from the entity's own baseline, ranked per entity-day.

    ``elevating_groups`` holds (merchant_id, date, groups): the feature groups with a positive
    contribution.  A control whose group is among them has high priority.
    """
    rules = F.array(
        *[
            F.struct(
                F.lit(c).alias("control_id"),
                F.lit(title).alias("title"),
                F.lit(direction).alias("direction"),
                F.lit(CONTROLS[c][0]).alias("group"),
                F.lit(CONTROLS[c][1]).alias("metric_label"),
                F.col(c).alias("current_value"),
                F.col(z).alias("deviation_z"),
                signed_badness(F.col(z), F.lit(direction)).alias("badness"),
            )
            for c, (z, direction, title) in RULES.items()
        ]
    )
    relevant = F.explode(F.filter(rules, lambda r: r["badness"] >= RELEVANCE_Z_THRESHOLD)).alias("r")
    candidates = features.select(*PANEL_KEYS, relevant).select(*PANEL_KEYS, "r.*")
    if elevating_groups is None:
        candidates = candidates.withColumn("corroborated", F.lit(False))
    else:
        candidates = candidates.join(elevating_groups, ["merchant_id", "date"], "left").withColumn(
            "corroborated", F.coalesce(F.array_contains("groups", F.col("group")), F.lit(False))
        ).drop("groups")
    side = F.when(F.col("direction") == "high_is_bad", "above").otherwise("below")
    reason = F.concat(
        F.col("metric_label"),
        F.format_string(" is %.1f%%, ", F.col("current_value") * 100),
        F.format_string("%.1f deviations ", F.abs("deviation_z")),
        side,
        F.lit(" this merchant's own baseline."),
        F.when(F.col("corroborated"), " Its feature group also pushes the modeled risk up.").otherwise(""),
    )
    ranked = rank_candidates(
        candidates.withColumn("priority", F.when(F.col("corroborated"), "high").otherwise("medium"))
    )
    return ranked.select(
        F.concat_ws(":", "merchant_id", "control_id", F.date_format("date", "yyyy-MM-dd")).alias("intervention_id"),
        *PANEL_KEYS,
        "control_id",
        "title",
        "group",
        "current_value",
        "deviation_z",
        "corroborated",
        "priority",
        "priority_rank",
        reason.alias("reason"),
    )


def relevance_coverage(features: DataFrame) -> DataFrame:
    """Share of entity-days past the relevance threshold, per rule."""
    shares = {
        c: F.avg((signed_badness(F.col(z), F.lit(d)) >= RELEVANCE_Z_THRESHOLD).cast("double"))
        for c, (z, d, _) in RULES.items()
    }
    return features.agg(*[v.alias(c) for c, v in shares.items()]).unpivot([], list(shares), "control_id", "share_of_rows")


def relevant_rule_counts(features: DataFrame, latest: DataFrame) -> DataFrame:
    """Number of entities by how many rules are relevant on their latest day."""
    hits = sum(
        (
            (signed_badness(F.col(z), F.lit(d)) >= RELEVANCE_Z_THRESHOLD).cast("long")
            for z, d, _ in list(RULES.values())[1:]
        ),
        (signed_badness(F.col("refund_rate_deviation_z"), F.lit("high_is_bad")) >= RELEVANCE_Z_THRESHOLD).cast("long"),
    )
    return (
        features.join(latest.select("merchant_id", "day_index"), ["merchant_id", "day_index"], "left_semi")
        .groupBy(hits.alias("n_relevant_rules"))
        .agg(F.count(F.lit(1)).alias("n_merchants"))
    )


# --- evidence and incidents ------------------------------------------------------------------

# Event type -> reason code, label, required evidence.
REASON_CODES = {
    "fulfillment_degradation": (
        "GOODS_OR_SERVICE_NOT_RECEIVED",
        "Goods or service not received",
        ["invoice", "payment_confirmation", "delivery_proof", "tracking_information"],
    ),
    "refund_shock": (
        "CREDIT_NOT_PROCESSED",
        "Credit not processed",
        ["invoice", "payment_confirmation", "refund_confirmation", "customer_communication"],
    ),
    "chargeback_deterioration": (
        "SUSPECTED_FRAUD_OR_UNAUTHORIZED",
        "Suspected fraud or unauthorized transaction",
        ["invoice", "payment_confirmation", "customer_communication", "service_access_records"],
    ),
    "customer_mix_shift": (
        "UNRECOGNIZED_TRANSACTION",
        "Unrecognized transaction",
        ["invoice", "payment_confirmation", "customer_communication", "service_access_records"],
    ),
    "compound_risk": (
        "MULTIPLE_FACTORS",
        "Multiple contributing factors",
        [
            "invoice",
            "payment_confirmation",
            "delivery_proof",
            "tracking_information",
            "refund_confirmation",
            "customer_communication",
        ],
    ),
}
# Order in which missing evidence is listed.
EVIDENCE_PRIORITY = [
    "payment_confirmation",
    "invoice",
    "delivery_proof",
    "tracking_information",
    "refund_confirmation",
    "customer_communication",
    "service_access_records",
]
ON_TIME_EVIDENCE_THRESHOLD = 0.70
ACCESS_LOG_ARCHETYPES = ["SaaS", "Digital Goods"]
COMMUNICATION_TIERS = ["mid", "large"]
SUSTAINED_FRACTION = 0.5
HIGH_CASE_COUNT = 5

# Priority reasons, in order.
REASON_STRESS = "Estimated exposure would consume all or more of this merchant's available liquidity."
REASON_NO_EVIDENCE = "No required evidence is currently available for this incident's reason code."
REASON_PARTIAL_EVIDENCE = "Required evidence for this incident's reason code is incomplete."
REASON_SUSTAINED = "The model's probability stayed at or above the decision threshold for most of this incident's window."
REASON_CASES = " chargeback occurrences were recorded during this incident's window."


def reason_code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(t, code, label, evidence) for t, (code, label, evidence) in REASON_CODES.items()],
        "event_type string, reason_code string, reason_code_label string, required_evidence array<string>",
    )


def with_reason_code(events: DataFrame, spark: SparkSession) -> DataFrame:
    """Attach reason codes; an event type without a code keeps its row with nulls."""
    # One row per event type of a fixed vocabulary.
    return events.join(F.broadcast(reason_code_table(spark)), "event_type", "left")


def readiness_status(available: Column, required: Column) -> Column:
    return (
        F.when(required <= 0, "ready")
        .when(available >= required, "ready")
        .when(available <= 0, "insufficient")
        .otherwise("partial")
    )


def evidence_readiness(incidents: DataFrame) -> DataFrame:
    """Add evidence items, counts, status and the ordered missing list.

    Needs required_evidence, window_on_time_rate, window_refund_count, archetype, business_tier.
    """
    shipped = F.col("window_on_time_rate") >= ON_TIME_EVIDENCE_THRESHOLD
    rules = {
        "invoice": (F.lit(True), "synthetic_prototype"),
        "payment_confirmation": (F.lit(True), "synthetic_prototype"),
        "delivery_proof": (shipped, "derived"),
        "tracking_information": (shipped, "derived"),
        "refund_confirmation": (F.col("window_refund_count") > 0, "derived"),
        "customer_communication": (F.col("business_tier").isin(COMMUNICATION_TIERS), "synthetic_prototype"),
        "service_access_records": (F.col("archetype").isin(ACCESS_LOG_ARCHETYPES), "synthetic_prototype"),
    }
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("category"),
                F.array_contains("required_evidence", name).alias("required"),
                F.coalesce(available, F.lit(False)).alias("available"),
                F.lit(provenance).alias("provenance"),
            )
            for name, (available, provenance) in rules.items()
        ]
    )
    with_items = incidents.withColumn("evidence_items", items)
    have = F.transform(F.filter("evidence_items", lambda i: i["available"]), lambda i: i["category"])
    missing = F.array_except("required_evidence", have)
    ordered = F.filter(F.array(*[F.lit(e) for e in EVIDENCE_PRIORITY]), lambda e: F.array_contains(F.col("_missing"), e))
    required = F.size("required_evidence").cast("long")
    available = required - F.size("_missing").cast("long")
    return (
        with_items.withColumn("_missing", missing)
        .withColumns(
            {
                "required_count": required,
                "available_count": available,
                "missing_evidence": ordered,
                "readiness_status": readiness_status(available, required),
            }
        )
        .drop("_missing")
    )


def priority_reasons(stress: Column, readiness: Column, flagged_fraction: Column, cases: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(stress >= STRESS_RED, REASON_STRESS),
            F.when(readiness == "insufficient", REASON_NO_EVIDENCE).when(readiness == "partial", REASON_PARTIAL_EVIDENCE),
            F.when(flagged_fraction >= SUSTAINED_FRACTION, REASON_SUSTAINED),
            F.when(cases >= HIGH_CASE_COUNT, F.concat(cases.cast("string"), F.lit(REASON_CASES))),
        )
    )


def priority_level(reasons: Column) -> Column:
    return F.when(F.size(reasons) >= 2, "high").when(F.size(reasons) == 1, "medium").otherwise("low")


def incidents(
    events: DataFrame,
    daily: DataFrame,
    dimension: DataFrame,
    scores: DataFrame,
    threshold: float,
    exposures: DataFrame,
    spark: SparkSession,
) -> DataFrame:
    """Risk events the model flagged on at least one of their days, as nested incident rows.

    ``scores`` holds (merchant_id, date, day_index, probability) for every entity-day.
    """
    risk = events.where(F.col("category") == "risk")
    flagged = scores.withColumn("flagged", F.col("probability") >= threshold)
    detected = detect_within_window(flagged, risk).where(F.col("detected_date").isNotNull())
    last_day = daily.groupBy("merchant_id").agg(F.max("date").alias("last_observed_date"))
    at_detection = scores.join(exposures.drop("day_index"), ["merchant_id", "date"]).select(
        "merchant_id",
        F.col("date").alias("detected_date"),
        "probability",
        "exposure",
        "available_liquidity",
        liquidity_stress(F.col("exposure"), F.col("available_liquidity")).alias("liquidity_stress"),
    )
    base = (
        with_reason_code(risk, spark)
        .join(detected, "event_id")
        .join(event_window_aggregates(daily, risk), "event_id")
        .join(at_detection, ["merchant_id", "detected_date"])
        .join(dimension.select("merchant_id", "archetype", "business_tier"), "merchant_id")
        .join(last_day, "merchant_id")
    )
    ready = evidence_readiness(base).withColumn("flagged_fraction", F.col("n_flagged") / F.col("n_days"))
    reasoned = ready.withColumn(
        "priority_reasons",
        priority_reasons(
            F.col("liquidity_stress"), F.col("readiness_status"), F.col("flagged_fraction"), F.col("estimated_case_count")
        ),
    )
    return reasoned.select(
        F.concat(F.lit("INC-"), "event_id").alias("incident_id"),
        "merchant_id",
        "event_type",
        F.when(F.col("recovery_end_date") >= F.col("last_observed_date"), "active").otherwise("resolved").alias("status"),
        priority_level(F.col("priority_reasons")).alias("priority"),
        "priority_reasons",
        F.struct("start_date", "end_date", "recovery_end_date", "duration_days").alias("window"),
        "detected_date",
        F.col("detected_day_index").alias("day_index"),
        F.struct(
            F.col("probability").alias("probability"),
            F.lit(threshold).alias("decision_threshold"),
            risk_state(F.col("probability"), threshold).alias("risk_state"),
            F.lit("modeled").alias("provenance"),
        ).alias("model"),
        F.struct("exposure", "available_liquidity", "liquidity_stress", F.lit("derived").alias("provenance")).alias("exposure"),
        F.struct(F.col("reason_code").alias("code"), F.col("reason_code_label").alias("label")).alias("reason_code"),
        F.struct(
            "required_evidence",
            F.col("evidence_items").alias("items"),
            "required_count",
            "available_count",
            "missing_evidence",
            "readiness_status",
        ).alias("evidence"),
        "estimated_case_count",
        F.struct(
            "event_id",
            "shape",
            "severity_score",
            F.split("affects", ",").alias("affects"),
            F.lit("synthetic_prototype").alias("provenance"),
        ).alias("scenario"),
        F.when(F.col("readiness_status") == "ready", "response_ready_for_merchant_review").otherwise("evidence_check").alias("workflow_stage"),
    )


def summarize_incidents(nested: DataFrame) -> DataFrame:
    return nested.select(
        "incident_id",
        "merchant_id",
        "event_type",
        "status",
        "priority",
        "window.start_date",
        "window.end_date",
        "window.recovery_end_date",
        "window.duration_days",
        "detected_date",
        F.col("model.probability").alias("probability"),
        F.col("model.risk_state").alias("risk_state"),
        F.col("exposure.exposure").alias("exposure_estimate"),
        F.col("exposure.liquidity_stress").alias("liquidity_stress"),
        F.col("reason_code.code").alias("reason_code"),
        F.col("reason_code.label").alias("reason_code_label"),
        F.col("evidence.readiness_status").alias("evidence_readiness_status"),
        F.array_join("evidence.missing_evidence", ",").alias("missing_evidence"),
        F.array_join("priority_reasons", " | ").alias("priority_reasons"),
        "estimated_case_count",
        "workflow_stage",
    )


# --- action log ------------------------------------------------------------------------------

# Accepted action statuses.
ACTION_STATUSES = ["reviewed", "simulated", "acknowledged", "dismissed"]


# The horizon of a simulation that states none.
DEFAULT_HORIZON = 30


def validate_actions(actions: DataFrame, dimension: DataFrame, daily: DataFrame, features: DataFrame) -> DataFrame:
    """Add the parsed id and ``error`` (null when valid) to a batch of action records.

    Actions carry merchant_id, intervention_id (entity:control:date), action_status and an
    optional ``simulation`` struct with ``as_of_date``, the control columns and ``horizon_days``
    (30 where the struct has no such field).  A simulated action whose scenario could not be run
    is an error, so that every logged simulation has its impact.
    """
    parts = F.split("intervention_id", ":")
    parsed = actions.withColumns(
        {
            "_n": F.size(parts),
            "_entity": F.try_element_at(parts, F.lit(1)),
            "control_id": F.try_element_at(parts, F.lit(2)),
            "_text_date": F.try_element_at(parts, F.lit(3)),
        }
    ).withColumn("date", F.when(F.col("_text_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("_text_date").try_cast("date")))
    known = parsed.join(dimension.select("merchant_id", F.lit(True).alias("_known")), "merchant_id", "left").join(
        daily.select("merchant_id", "date", F.col("day_index").alias("_day")), ["merchant_id", "date"], "left"
    )
    simulated = F.col("action_status") == "simulated"
    control_set = F.coalesce(
        *[F.when((F.col("control_id") == c) & F.col(f"simulation.{c}").isNotNull(), F.lit(True)) for c in CONTROLS],
        F.lit(False),
    )
    stated = "horizon_days" in actions.schema["simulation"].dataType.fieldNames()
    horizon = F.col("simulation.horizon_days") if stated else F.lit(DEFAULT_HORIZON)
    controls = {c: F.col(f"simulation.{c}") for c in CONTROLS}
    scenario = _request_error(horizon, controls, features, F.lit(True), F.lit(True))
    error = (
        F.when(F.col("_n") != 3, "malformed_id")
        .when(F.col("_entity") != F.col("merchant_id"), "entity_mismatch")
        .when(~F.col("control_id").isin(list(RULES)), "unknown_control")
        .when(F.col("date").isNull(), "invalid_date")
        .when(F.col("_known").isNull(), "merchant_not_found")
        .when(F.col("_day").isNull(), "date_not_available")
        .when(~F.coalesce(F.col("action_status").isin(ACTION_STATUSES), F.lit(False)), "invalid_status")
        .when(simulated & F.col("simulation").isNull(), "simulation_required")
        .when(~simulated & F.col("simulation").isNotNull(), "simulation_not_applicable")
        .when(simulated & (F.col("simulation.as_of_date") != F.col("date")), "simulation_date_mismatch")
        .when(simulated & ~control_set, "simulation_control_mismatch")
        .when(simulated & scenario.isNotNull(), F.concat(F.lit("simulation:"), scenario))
    )
    return known.withColumn("error", error).drop("_n", "_entity", "_text_date", "_known", "_day")


OUTCOME_NOTE = "What followed this action was not observed: the data end with the action, so no effect of it is on record."


def action_log(valid: DataFrame, impacts: DataFrame | None = None, request_id: str = "request_id") -> DataFrame:
    """Log records for valid actions; ``impacts`` is the output of :func:`simulate` for them."""
    titles = F.create_map(*[x for c, (_, _, title) in RULES.items() for x in (F.lit(c), F.lit(title))])
    records = valid.where(F.col("error").isNull()).withColumns(
        {
            "recommendation_title": titles[F.col("control_id")],
            "outcome_status": F.lit("not_observed"),
            "outcome_note": F.lit(OUTCOME_NOTE),
            "timestamp": F.current_timestamp(),
        }
    )
    if impacts is None:
        return records
    impact = impacts.select(
        request_id,
        F.struct(
            "current_probability", "simulated_probability", "probability_delta", "exposure_current", "exposure_simulated",
            "stress_current", "stress_simulated", F.lit("modeled").alias("provenance"),
        ).alias("simulated_impact"),
    )
    return records.join(impact, request_id, "left")


def append_actions(records: DataFrame, path: str, batch_id: str) -> int:
    """Append a batch to the log below ``path`` and return how many records were new.

    The log holds one folder per batch.  A batch is written beside its place and renamed into it, so readers
    see all of it or nothing; a batch whose id is there already is left alone.  Of records that repeat
    a request id, within the batch or against the log, the log keeps one.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id) or batch_id.startswith(("_", ".")):
        raise ValueError(f"batch id {batch_id!r} is not a plain name")
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}")
    if system.exists(place):
        return 0
    # Equal requests may differ in their time stamps; the smallest record stays, whatever the order of rows.
    fresh = records.dropDuplicates().groupBy("request_id").agg(F.min_by(F.struct(*records.columns), F.to_json(F.struct(*records.columns))).alias("r")).select("r.*")
    if system.exists(folder) and any(s.getPath().getName().startswith("batch=") for s in system.listStatus(folder)):
        fresh = fresh.join(read_actions(spark, path).select("request_id"), "request_id", "left_anti").select(*records.columns)
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    fresh.write.parquet(draft)
    system.mkdirs(folder)
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), place):
        raise OSError(f"could not move the batch into {place}")
    return spark.read.parquet(f"{path}/batch={batch_id}").count()


def read_actions(spark: SparkSession, path: str, merchant_id: str | None = None) -> DataFrame:
    """The log with each record's batch; of one entity if given, newest action date first."""
    log = spark.read.parquet(path)
    return log if merchant_id is None else log.where(F.col("merchant_id") == merchant_id).orderBy(F.desc("date"), "request_id")
