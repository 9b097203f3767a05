"""DuckDB SQL by query name."""

from __future__ import annotations

from oracle.base import FEATURES, LABEL_DOUBLES, METHODS, PANEL_DOUBLES, PANEL_LONGS, fixed_list, fx, with_

ORACLE: dict[str, str] = {}

MERCHANT_DOUBLES = [
    "baseline_daily_gmv", "baseline_daily_txn_count", "baseline_aov", "baseline_refund_rate", "baseline_chargeback_rate",
    "baseline_fulfillment_delay_days", "baseline_on_time_rate", "baseline_new_customer_rate", *[f"baseline_pct_pay_{m}" for m in METHODS],
    "annual_growth_rate", "volatility_factor", "liquidity_buffer_days",
]

for _suffix, _p in (("", ""), ("_supplier", "s_")):
    ORACLE[f"daily_panel{_suffix}"] = with_(
        f"SELECT merchant_id, date, day_index, {', '.join(PANEL_LONGS)}, {fixed_list(PANEL_DOUBLES)} FROM {_p}panel", f"{_p}panel"
    )
    ORACLE[f"features{_suffix}"] = with_(f"SELECT merchant_id, date, day_index, {fixed_list(FEATURES)} FROM {_p}features", f"{_p}features")
    ORACLE[f"labels{_suffix}"] = with_(
        f"SELECT merchant_id, as_of_date, day_index, horizon_days, future_transaction_count, label_elevated_chargeback, {fixed_list(LABEL_DOUBLES)} FROM {_p}labels_t",
        f"{_p}labels_t",
    )
ORACLE["merchants"] = with_(
    f"SELECT merchant_id, archetype, business_tier, signup_date, weekly_seasonality_profile, settlement_cycle_days, {fixed_list(MERCHANT_DOUBLES)} FROM merchants",
    "merchants",
)
ORACLE["scenario_events"] = with_(f"SELECT * EXCLUDE (severity_score), {fx('severity_score')} AS severity_score FROM events_t", "events_t")

from oracle import audits  # noqa: E402

ORACLE.update(audits.SQL)

from oracle import evaluation  # noqa: E402

ORACLE.update(evaluation.SQL)

from oracle import decisions  # noqa: E402

ORACLE.update(decisions.SQL)
