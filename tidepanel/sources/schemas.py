"""Table contracts: the column sets every dataset has to honour."""

from __future__ import annotations

from pyspark.sql import types as T

# Payment methods, in column order.
PAYMENT_METHODS = ["card", "upi", "netbanking", "wallet", "bnpl"]

_STR, _DATE, _DBL, _INT, _BOOL = (
    T.StringType(),
    T.DateType(),
    T.DoubleType(),
    T.LongType(),
    T.BooleanType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


MERCHANTS = _struct(
    merchant_id=_STR,
    archetype=_STR,
    business_tier=_STR,
    signup_date=_DATE,
    baseline_daily_gmv=_DBL,
    baseline_daily_txn_count=_DBL,
    baseline_aov=_DBL,
    baseline_refund_rate=_DBL,
    baseline_chargeback_rate=_DBL,
    baseline_fulfillment_delay_days=_DBL,
    baseline_on_time_rate=_DBL,
    baseline_new_customer_rate=_DBL,
    **{f"baseline_pct_pay_{m}": _DBL for m in PAYMENT_METHODS},
    annual_growth_rate=_DBL,
    volatility_factor=_DBL,
    liquidity_buffer_days=_DBL,
    settlement_cycle_days=_INT,
    weekly_seasonality_profile=_STR,
)

DAILY = _struct(
    merchant_id=_STR,
    date=_DATE,
    day_index=_INT,
    gmv=_DBL,
    transaction_count=_INT,
    aov=_DBL,
    refund_count=_INT,
    refund_amount=_DBL,
    refund_rate=_DBL,
    chargeback_count=_INT,
    chargeback_amount=_DBL,
    chargeback_rate=_DBL,
    fulfillment_delay_avg_days=_DBL,
    fulfillment_on_time_rate=_DBL,
    customer_count=_INT,
    new_customers=_INT,
    returning_customers=_INT,
    new_customer_rate=_DBL,
    **{f"pct_pay_{m}": _DBL for m in PAYMENT_METHODS},
    liquidity_balance=_DBL,
    pending_settlement_amount=_DBL,
)

SCENARIO_EVENTS = _struct(
    event_id=_STR,
    merchant_id=_STR,
    event_type=_STR,
    category=_STR,
    hard_negative=_BOOL,
    shape=_STR,
    start_date=_DATE,
    end_date=_DATE,
    recovery_end_date=_DATE,
    duration_days=_INT,
    severity_score=_DBL,
    affects=_STR,
    description=_STR,
)

LABELS = _struct(
    merchant_id=_STR,
    as_of_date=_DATE,
    day_index=_INT,
    horizon_days=_INT,
    future_chargeback_amount=_DBL,
    future_chargeback_rate=_DBL,
    future_transaction_count=_INT,
    baseline_daily_gmv_trailing=_DBL,
    baseline_daily_chargeback_amount_trailing=_DBL,
    baseline_chargeback_rate_trailing=_DBL,
    elevation_ratio_amount=_DBL,
    elevation_ratio_rate=_DBL,
    label_elevated_chargeback=_INT,
)

TABLES = {
    "merchants": MERCHANTS,
    "daily_observations": DAILY,
    "events": SCENARIO_EVENTS,
    "labels": LABELS,
}

PANEL_KEYS = ["merchant_id", "date", "day_index"]
