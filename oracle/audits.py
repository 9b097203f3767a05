"""SQL for structure, effect, label and leakage audits."""

from __future__ import annotations

from oracle.base import FEATURES, METHODS, cte, fixed_list, floor_ratio, fx, with_

SQL: dict[str, str] = {}

TYPES = ["chargeback_deterioration", "refund_shock", "fulfillment_degradation", "customer_mix_shift", "festival_growth"]
CORE = [
    "transaction_count", "gmv", "aov", "refund_count", "refund_rate", "chargeback_count", "chargeback_rate",
    "fulfillment_on_time_rate", "fulfillment_delay_avg_days", "new_customer_rate", "liquidity_balance", "pending_settlement_amount",
]
QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def summary(value: str) -> str:
    parts = [f"count({value}) AS count", f"{fx(f'avg({value})')} AS mean", f"{fx(f'stddev_samp({value})')} AS std"]
    parts += [f"{fx(f'min({value})')} AS min", f"{fx(f'max({value})')} AS max"]
    parts += [f"{fx(f'quantile_cont({value}, {p})')} AS {n}" for n, p in QUANTILES.items()]
    return ", ".join(parts)


def long(cols, table: str, keys: str = "", name: str = "metric") -> str:
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {lead}'{c}' AS {name}, ({c})::DOUBLE AS value FROM {table}" for c in cols)


def auc(source: str, keys: str, score: str = "score", label: str = "y") -> str:
    """Rank-sum AUC over (keys, score, y) rows, average ranks on ties."""
    part = f"PARTITION BY {keys}" if keys else ""
    part_tie = f"PARTITION BY {keys}, {score}" if keys else f"PARTITION BY {score}"
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}sum({label})::BIGINT AS n_positive, (count(*) - sum({label}))::BIGINT AS n_negative,
        {fx(f"CASE WHEN sum({label}) > 0 AND sum({label}) < count(*) THEN (sum(CASE WHEN {label} = 1 THEN rk END) - sum({label}) * (sum({label}) + 1) / 2.0) / (sum({label}) * (count(*) - sum({label}))::DOUBLE) END")} AS roc_auc
        FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({part_tie}) - 1) / 2.0 AS rk FROM ({source}) WHERE {score} IS NOT NULL)
        {f"GROUP BY {keys}" if keys else ""}"""


SQL["panel_structure"] = with_(
    """SELECT count(*) AS n_merchants, sum(n)::BIGINT AS n_daily_rows, min(n) AS min_days_per_merchant, max(n) AS max_days_per_merchant,
        min(lo) AS min_date, max(hi) AS max_date FROM (SELECT merchant_id, count(*) AS n, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1)""",
    "panel",
)
for _s, _p in (("", ""), ("_supplier", "s_")):
    SQL[f"gap_audit{_s}"] = with_(
        f"""SELECT merchant_id, count(*) AS n_days, NOT (list(day_index ORDER BY day_index) = range(count(*))) AS day_index_gap,
            NOT (date_diff('day', min(date), max(date)) + 1 = count(*) AND count(DISTINCT date) = count(*)) AS date_gap
        FROM {_p}panel GROUP BY merchant_id""",
        f"{_p}panel",
    )
SQL["duplicate_counts"] = with_(
    """SELECT 'merchants' AS table_name, (SELECT count(*) - count(DISTINCT merchant_id) FROM dimension) AS n_duplicates
    UNION ALL SELECT 'daily_observations', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM panel GROUP BY merchant_id, date))
    UNION ALL SELECT 'events', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM events_t GROUP BY merchant_id, start_date))
    UNION ALL SELECT 'labels', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM labels_t GROUP BY merchant_id, as_of_date, horizon_days))""",
    "dimension", "panel", "events_t", "labels_t",
)
SQL["null_counts"] = with_(
    """SELECT 'labels_wide' AS table_name, c AS column_name, n AS n_missing, 'bigint' AS data_type FROM (
        SELECT unnest(['7', '14', '30']) AS c, unnest([count(*) FILTER (WHERE h7 IS NULL), count(*) FILTER (WHERE h14 IS NULL), count(*) FILTER (WHERE h30 IS NULL)]) AS n
        FROM (SELECT merchant_id, as_of_date, max(CASE WHEN horizon_days = 7 THEN label_elevated_chargeback END) AS h7,
            max(CASE WHEN horizon_days = 14 THEN label_elevated_chargeback END) AS h14, max(CASE WHEN horizon_days = 30 THEN label_elevated_chargeback END) AS h30
            FROM labels_t GROUP BY 1, 2)) WHERE n > 0""",
    "labels_t",
)
_mix = " + ".join(f"pct_pay_{m}" for m in METHODS)
_rules = {
    "negative_gmv": "gmv < 0",
    "negative_transaction_count": "transaction_count < 1",
    "negative_refund_amount": "refund_amount < 0",
    "negative_chargeback_amount": "chargeback_amount < 0",
    "negative_liquidity_balance": "liquidity_balance < 0",
    "refund_amount_exceeds_gmv": "refund_amount > gmv + 1e-6",
    "refund_count_exceeds_transactions": "refund_count > transaction_count",
    "chargeback_count_exceeds_transactions": "chargeback_count > transaction_count",
    "chargeback_amount_exceeds_gmv_same_day": "chargeback_amount > gmv",
    "customer_split_inconsistent": "new_customers + returning_customers <> customer_count",
    "aov_times_txn_not_equal_gmv": "transaction_count >= 1 AND NOT abs(aov * transaction_count - gmv) <= 1e-3 + 1e-6 * abs(gmv)",
    "payment_mix_not_summing_to_one": f"transaction_count >= 1 AND NOT abs({_mix} - 1) <= 1e-6 + 1e-5",
    **{f"{r}_out_of_unit_interval": f"NOT ({r} BETWEEN 0 AND 1)" for r in ("refund_rate", "chargeback_rate", "fulfillment_on_time_rate", "new_customer_rate")},
}
SQL["rule_suite"] = with_(
    " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS n_violations FROM panel" for n, c in _rules.items()), "panel"
)
SQL["event_overlaps"] = with_(
    """SELECT merchant_id, count(*) AS n_events, count(*) FILTER (WHERE start_date <= prev) AS n_overlaps FROM (
        SELECT merchant_id, start_date, lag(recovery_end_date) OVER (PARTITION BY merchant_id ORDER BY start_date, event_id) AS prev FROM events_t)
    GROUP BY merchant_id""",
    "events_t",
)
SQL["dataset_manifest"] = with_(
    """SELECT 'daily_observations' AS table_name, count(*) AS n_rows, max(date) AS max_date FROM panel
    UNION ALL SELECT 'labels', count(*), max(as_of_date) FROM labels_t UNION ALL SELECT 'events', count(*), max(end_date) FROM events_t""",
    "panel", "labels_t", "events_t",
)
SQL["event_category_counts"] = with_(
    f"SELECT event_type AS value, count(*) AS n, {fx('count(*)::DOUBLE / (SELECT count(*) FROM events_t)')} AS share FROM events_t GROUP BY 1", "events_t"
)
SQL["archetype_counts"] = with_(
    f"""SELECT value, n, {fx('m')} AS mean_count, n < m * 0.7 AS underrepresented
    FROM (SELECT archetype AS value, count(*) AS n, avg(count(*)) OVER () AS m FROM s_dimension GROUP BY 1)""",
    "s_dimension",
)
_beh = ["gmv", "aov", "refund_rate", "chargeback_rate", "fulfillment_on_time_rate", "new_customer_rate"]
cte("located", "SELECT p.*, d.archetype, d.business_tier FROM panel p JOIN dimension d USING (merchant_id)", "panel", "dimension")
SQL["archetype_medians"] = with_(
    f"SELECT archetype, metric, {fx('quantile_cont(value, 0.5)')} AS median FROM ({long(_beh, 'located', 'archetype')}) GROUP BY 1, 2", "located"
)
for _s, _p in (("", ""), ("_supplier", "s_")):
    SQL[f"core_distributions{_s}"] = with_(f"SELECT metric, {summary('value')} FROM ({long(CORE, _p + 'panel')}) GROUP BY 1", f"{_p}panel")
cte(
    "ratios",
    """SELECT CASE WHEN gmv <> 0 THEN chargeback_amount / gmv END AS chargeback_amount_to_gmv_ratio, CASE WHEN gmv <> 0 THEN refund_amount / gmv END AS refund_amount_to_gmv_ratio,
        pending_settlement_amount / (settlement_cycle_days * greatest(gmv, 1.0)) AS pending_settlement_to_expected_scale_ratio FROM panel JOIN merchants USING (merchant_id)""",
    "panel", "merchants",
)
_ratio = ["chargeback_amount_to_gmv_ratio", "refund_amount_to_gmv_ratio", "pending_settlement_to_expected_scale_ratio"]
SQL["financial_ratios"] = with_(f"SELECT ratio, {summary('value')} FROM ({long(_ratio, 'ratios', '', 'ratio')}) GROUP BY 1", "ratios")

# Interval join by range predicate (the library expands intervals to days).
cte(
    "tagged",
    """SELECT p.*, coalesce(e.event_type, 'normal') AS active_event_type, coalesce(e.category, 'normal') AS active_event_category
    FROM panel p LEFT JOIN (
        SELECT p.merchant_id, p.date, e.event_type, e.category,
            row_number() OVER (PARTITION BY p.merchant_id, p.date ORDER BY e.start_date DESC, e.event_id DESC) AS rn
        FROM panel p JOIN events_t e ON p.merchant_id = e.merchant_id AND p.date BETWEEN e.start_date AND e.recovery_end_date) e
    ON p.merchant_id = e.merchant_id AND p.date = e.date AND e.rn = 1""",
    "panel", "events_t",
)
SQL["tagged_days"] = with_("SELECT merchant_id, date, active_event_type, active_event_category FROM tagged", "tagged")
cte(
    "pooled",
    """SELECT active_event_type, any_value(active_event_category) AS category, count(*) AS n_merchant_days, count(DISTINCT t.merchant_id) AS n_distinct_merchants,
        (sum(gmv_c)::DOUBLE / 100) / sum(baseline_daily_gmv) AS gmv_ratio_vs_baseline,
        sum(transaction_count)::DOUBLE / sum(baseline_daily_txn_count) AS transaction_count_ratio_vs_baseline,
        CASE WHEN avg(baseline_new_customer_rate) > 1e-9 THEN avg(new_customer_rate) / avg(baseline_new_customer_rate) END AS new_customer_rate_ratio_vs_baseline,
        CASE WHEN sum(baseline_chargeback_rate * transaction_count) > 1e-9 THEN sum(chargeback_count)::DOUBLE / sum(baseline_chargeback_rate * transaction_count) END AS chargeback_rate_ratio_vs_baseline,
        CASE WHEN sum(baseline_refund_rate * transaction_count) > 1e-9 THEN sum(refund_count)::DOUBLE / sum(baseline_refund_rate * transaction_count) END AS refund_rate_ratio_vs_baseline,
        avg(fulfillment_on_time_rate) - avg(baseline_on_time_rate) AS fulfillment_on_time_rate_delta_vs_baseline
    FROM tagged t JOIN merchants m ON t.merchant_id = m.merchant_id GROUP BY active_event_type""",
    "tagged", "merchants",
)
EFFECTS = [
    "gmv_ratio_vs_baseline", "transaction_count_ratio_vs_baseline", "chargeback_rate_ratio_vs_baseline", "refund_rate_ratio_vs_baseline",
    "fulfillment_on_time_rate_delta_vs_baseline",
]
SQL["pooled_effects"] = with_(
    f"SELECT active_event_type, category, n_merchant_days, n_distinct_merchants, {fixed_list(EFFECTS + ['new_customer_rate_ratio_vs_baseline'])} FROM pooled", "pooled"
)
cte(
    "rollup_t",
    "SELECT category, sum(n_merchant_days)::BIGINT AS n_merchant_days, "
    + ", ".join(f"sum({c} * n_merchant_days) / sum(n_merchant_days) AS {c}" for c in EFFECTS)
    + " FROM pooled GROUP BY category",
    "pooled",
)
SQL["effects_by_category"] = with_(f"SELECT category, n_merchant_days, {fixed_list(EFFECTS)} FROM rollup_t", "rollup_t")
SQL["growth_is_not_risk"] = with_(
    f"""SELECT {fixed_list(['benign_gmv_ratio', 'benign_chargeback_ratio', 'benign_refund_ratio', 'risk_chargeback_ratio'])},
        coalesce(benign_gmv_ratio, 0) > 1.3 AND coalesce(benign_chargeback_ratio, 99) < 1.5 AND coalesce(benign_refund_ratio, 99) < 1.5
        AND coalesce(risk_chargeback_ratio, 0) > coalesce(benign_chargeback_ratio, 0) AS growth_ne_risk_verdict
    FROM (SELECT max(gmv_ratio_vs_baseline) FILTER (WHERE category = 'benign_growth') AS benign_gmv_ratio,
        max(chargeback_rate_ratio_vs_baseline) FILTER (WHERE category = 'benign_growth') AS benign_chargeback_ratio,
        max(refund_rate_ratio_vs_baseline) FILTER (WHERE category = 'benign_growth') AS benign_refund_ratio,
        max(chargeback_rate_ratio_vs_baseline) FILTER (WHERE category = 'risk') AS risk_chargeback_ratio FROM rollup_t)""",
    "rollup_t",
)
SQL["event_duration_summary"] = with_(f"SELECT event_type, {summary('duration_days::DOUBLE')} FROM events_t GROUP BY 1", "events_t")
SQL["event_severity_summary"] = with_(f"SELECT event_type, {summary('severity_score')} FROM events_t GROUP BY 1", "events_t")
SQL["event_archetype_crosstab"] = with_(
    "SELECT archetype, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events_t JOIN dimension USING (merchant_id) GROUP BY 1",
    "events_t", "dimension",
)
SQL["event_concentration"] = with_(
    """SELECT event_type, count(*) AS n_events, count(DISTINCT merchant_id) AS n_distinct_merchants,
        round_even(count(*)::DOUBLE / count(DISTINCT merchant_id), 2) AS events_per_merchant_that_has_it FROM events_t GROUP BY 1""",
    "events_t",
)
SQL["event_archetype_shares"] = with_(
    """, pairs AS (SELECT event_type, archetype, count(*) AS n FROM events_t JOIN dimension USING (merchant_id) GROUP BY 1, 2)
    SELECT t.event_type, a.archetype, round_even(coalesce(p.n, 0)::DOUBLE / t.n, 3) AS observed_share, round_even(a.n::DOUBLE / (SELECT sum(n) FROM pairs), 3) AS expected_share_if_uniform
    FROM (SELECT event_type, sum(n) AS n FROM pairs GROUP BY 1) t CROSS JOIN (SELECT archetype, sum(n) AS n FROM pairs GROUP BY 1) a
    LEFT JOIN pairs p ON p.event_type = t.event_type AND p.archetype = a.archetype""",
    "events_t", "dimension",
)
SQL["fulfillment_events_by_archetype_membership"] = with_(
    """SELECT archetype, business_tier, count(*) AS n_events FROM events_t JOIN dimension USING (merchant_id)
    WHERE event_type = 'fulfillment_degradation' AND archetype IN ('ASIA', 'EUROPE') AND business_tier IN ('mid', 'large') GROUP BY 1, 2""",
    "events_t", "dimension",
)
for _s, _p in (("", ""), ("_supplier", "s_")):
    SQL[f"label_prevalence{_s}"] = with_(
        f"""SELECT horizon_days, sum(n)::BIGINT AS usable_rows, sum(p)::BIGINT AS positives, (sum(n) - sum(p))::BIGINT AS negatives,
            {fx('sum(p)::DOUBLE / sum(n)')} AS positive_rate, sum(p)::DOUBLE / sum(n) BETWEEN 0.05 AND 0.6 AS within_band,
            {fx('min(p::DOUBLE / n)')} AS min_merchant_rate, {fx('max(p::DOUBLE / n)')} AS max_merchant_rate, {fx('quantile_cont(p::DOUBLE / n, 0.5)')} AS median_merchant_rate,
            count(*) FILTER (WHERE p = 0) AS n_merchants_with_zero_positives, count(*) FILTER (WHERE p = n) AS n_merchants_all_positive, count(*) AS n_merchants_total
        FROM (SELECT horizon_days, merchant_id, count(*) AS n, sum(label_elevated_chargeback) AS p FROM {_p}labels_t GROUP BY 1, 2) GROUP BY 1""",
        f"{_p}labels_t",
    )
SQL["label_prevalence_by_archetype"] = with_(
    """SELECT horizon_days, archetype, count(*) AS rows, sum(label_elevated_chargeback)::BIGINT AS positives,
        round_even(avg(label_elevated_chargeback), 4) AS positive_rate FROM labels_t JOIN dimension USING (merchant_id) GROUP BY 1, 2""",
    "labels_t", "dimension",
)
cte(
    "wide",
    """SELECT a.merchant_id, a.as_of_date, a.label_elevated_chargeback::DOUBLE AS h7, b.label_elevated_chargeback::DOUBLE AS h14, c.label_elevated_chargeback::DOUBLE AS h30
    FROM labels_t a JOIN labels_t b ON a.merchant_id = b.merchant_id AND a.as_of_date = b.as_of_date JOIN labels_t c ON a.merchant_id = c.merchant_id AND a.as_of_date = c.as_of_date
    WHERE a.horizon_days = 7 AND b.horizon_days = 14 AND c.horizon_days = 30""",
    "labels_t",
)
SQL["horizon_pivot"] = with_("SELECT * FROM wide", "wide")
_hs = (7, 14, 30)
_agree = ["count(*) AS n_rows"] + [f"{fx(f'avg(h{h})')} AS prevalence_h{h}" for h in _hs]
_agree += [
    f"{fx(f'avg(h{b}) FILTER (WHERE h{a} = 1)')} AS p_h{b}_given_h{a}" for a in _hs for b in _hs if a != b
]
_agree += [
    f"{fx(f'count(*) FILTER (WHERE h{a} = 1 AND h{b} = 1)::DOUBLE / nullif(count(*) FILTER (WHERE h{a} = 1 OR h{b} = 1), 0)')} AS jaccard_h{a}_h{b}"
    for a in _hs for b in _hs if a < b
]
_agree.append(f"{fx('avg(CASE WHEN h7 = h14 AND h14 = h30 THEN 1.0 ELSE 0.0 END::DOUBLE)')} AS fraction_all_agree")
SQL["horizon_agreement"] = with_(f"SELECT {', '.join(_agree)} FROM wide", "wide")
SQL["liquidity_trend_by_category"] = with_(
    f"""SELECT active_event_category, {fx('avg(delta / (baseline_daily_gmv * liquidity_buffer_days))')} AS mean_normalized_liquidity_change
    FROM (SELECT merchant_id, active_event_category, liquidity_balance - lag(liquidity_balance) OVER (PARTITION BY merchant_id ORDER BY day_index) AS delta FROM tagged)
    JOIN merchants USING (merchant_id) GROUP BY 1""",
    "tagged", "merchants",
)
cte(
    "aligned",
    """SELECT e.event_id, e.event_type, date_diff('day', e.start_date, p.date) AS o, p.rate FROM events_t e JOIN (
        SELECT merchant_id, date, CASE WHEN t <> 0 THEN c::DOUBLE / t END AS rate FROM (SELECT merchant_id, date,
            sum(chargeback_count) OVER w AS c, sum(transaction_count) OVER w AS t FROM panel WINDOW w AS (PARTITION BY merchant_id ORDER BY day_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))) p
    ON e.merchant_id = p.merchant_id AND p.date BETWEEN e.start_date - 20 AND e.start_date + 72 WHERE e.category = 'risk'""",
    "events_t", "panel",
)
SQL["event_aligned_rates"] = with_(
    f"SELECT event_type, o::INTEGER AS \"offset\", {fx('avg(rate)')} AS mean_rate, count(rate) AS n_values FROM aligned WHERE o BETWEEN -20 AND 60 GROUP BY 1, 2", "aligned"
)
cte(
    "detections",
    """SELECT a.event_id, a.event_type, any_value(b.baseline) AS baseline, min(CASE WHEN b.baseline IS NOT NULL AND a.o BETWEEN 3 AND 70 AND a.n3 = 3
            AND a.m3 >= greatest(b.baseline * 1.3, b.baseline + 0.003, 0.004::DOUBLE) THEN a.o END) AS detection_offset_days
    FROM (SELECT x.event_id, x.event_type, x.o, count(y.rate) AS n3, sum(y.rate ORDER BY y.o) / count(y.rate) AS m3
          FROM aligned x JOIN aligned y ON x.event_id = y.event_id AND y.o BETWEEN x.o AND x.o + 2 GROUP BY 1, 2, 3) a
    JOIN (SELECT event_id, CASE WHEN count(rate) FILTER (WHERE o BETWEEN -20 AND -1) >= 5 THEN avg(rate) FILTER (WHERE o BETWEEN -20 AND -1) END AS baseline FROM aligned GROUP BY 1) b
    ON a.event_id = b.event_id GROUP BY 1, 2""",
    "aligned",
)
SQL["uplift_detection"] = with_(f"SELECT event_id, event_type, {fx('baseline')} AS baseline, detection_offset_days::DOUBLE AS detection_offset_days FROM detections", "detections")
SQL["warning_structure"] = with_(
    f"""SELECT event_type, count(*) AS n_instances, count(baseline) AS n_instances_with_valid_pre_window, count(detection_offset_days) AS n_instances_with_detectable_uplift,
        {fx('count(detection_offset_days)::DOUBLE / nullif(count(baseline), 0)')} AS fraction_detectable,
        {', '.join(f"{fx(f'quantile_cont(detection_offset_days::DOUBLE, {q})')} AS {n}_detection_offset_days" for n, q in (('p25', 0.25), ('median', 0.5), ('p75', 0.75)))}
    FROM detections GROUP BY 1""",
    "detections",
)
cte(
    "event_sums",
    """SELECT e.event_id, sum(p.chargeback_count)::BIGINT AS estimated_case_count, sum(p.refund_count)::BIGINT AS window_refund_count,
        CASE WHEN sum(p.transaction_count) > 0 THEN sum(p.fulfillment_on_time_rate * p.transaction_count) / sum(p.transaction_count) ELSE 1.0 END AS window_on_time_rate
    FROM events_t e JOIN panel p ON e.merchant_id = p.merchant_id AND p.date BETWEEN e.start_date AND e.end_date GROUP BY 1""",
    "events_t", "panel",
)
SQL["event_window_aggregates"] = with_(f"SELECT event_id, estimated_case_count, window_refund_count, {fx('window_on_time_rate')} AS window_on_time_rate FROM event_sums", "event_sums")
SQL["leakage_auc_baseline_rate"] = with_(
    auc("SELECT horizon_days, baseline_chargeback_rate AS score, label_elevated_chargeback AS y FROM labels_t JOIN merchants USING (merchant_id)", "horizon_days"),
    "labels_t", "merchants",
)
SQL["leakage_auc_risk_day"] = with_(
    auc(
        "SELECT l.horizon_days, (t.active_event_category = 'risk')::INTEGER AS score, l.label_elevated_chargeback AS y FROM labels_t l JOIN tagged t ON l.merchant_id = t.merchant_id AND l.day_index = t.day_index",
        "horizon_days",
    ),
    "labels_t", "tagged",
)
cte(
    "difficulty",
    f"""SELECT l.horizon_days, l.label_elevated_chargeback AS y, p.* FROM labels_t l LEFT JOIN (SELECT merchant_id, day_index, chargeback_rate, gmv,
        CASE WHEN sum(transaction_count) OVER w <> 0 THEN (sum(chargeback_count) OVER w)::DOUBLE / sum(transaction_count) OVER w END AS trailing_chargeback_rate_28d,
        {fx('avg(gmv) OVER w', 4)} AS trailing_gmv_28d_mean FROM panel WINDOW w AS (PARTITION BY merchant_id ORDER BY day_index ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)) p
    ON l.merchant_id = p.merchant_id AND l.day_index = p.day_index""",
    "labels_t", "panel",
)
_diff = ["chargeback_rate", "gmv", "trailing_chargeback_rate_28d", "trailing_gmv_28d_mean"]
SQL["difficulty_auc"] = with_(
    auc(" UNION ALL ".join(f"SELECT horizon_days, '{c}' AS feature, {c} AS score, y FROM difficulty" for c in _diff), "horizon_days, feature"), "difficulty"
)
SQL["difficulty_assessment"] = with_(
    f"""SELECT max(roc_auc) AS highest_auc, min(roc_auc) AS lowest_auc, CASE
        WHEN max(roc_auc) > 0.97 AND min(roc_auc) < 0.55 THEN 'a causal feature alone is close to perfect: look for leakage; causal features alone are weak at some horizon: the label may be hard to learn there'
        WHEN max(roc_auc) > 0.97 THEN 'a causal feature alone is close to perfect: look for leakage'
        WHEN min(roc_auc) < 0.55 THEN 'causal features alone are weak at some horizon: the label may be hard to learn there'
        ELSE 'causal features alone carry some signal and do not settle the label' END AS assessment
    FROM ({auc(" UNION ALL ".join(f"SELECT horizon_days, '{c}' AS feature, {c} AS score, y FROM difficulty" for c in _diff[2:]), "horizon_days, feature")})""",
    "difficulty",
)
SQL["threshold_boundary_share"] = with_(
    f"SELECT horizon_days, {fx('avg(CASE WHEN abs(elevation_ratio_amount - 1.75) < 0.1::DOUBLE * 1.75::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE)')} AS near_boundary_fraction FROM labels_t GROUP BY 1",
    "labels_t",
)
cte(
    "encoded",
    "SELECT l.horizon_days, l.label_elevated_chargeback AS y, avg(l.label_elevated_chargeback) OVER (PARTITION BY l.horizon_days, d.archetype) AS score FROM labels_t l JOIN dimension d USING (merchant_id)",
    "labels_t", "dimension",
)
SQL["archetype_bias"] = with_(
    f"""SELECT a.horizon_days, {fx('r.ratio')} AS max_over_min_ratio, a.roc_auc AS mean_encoded_auc, a.roc_auc > 0.65 AS meaningful_shortcut
    FROM ({auc('SELECT horizon_days, score, y FROM encoded', 'horizon_days')}) a
    JOIN (SELECT horizon_days, max(score) / greatest(min(score), 1e-9) AS ratio FROM encoded GROUP BY 1) r ON a.horizon_days = r.horizon_days""",
    "encoded",
)


# Content digests of the given tables: column order as in the files, fractions to six digits.
_INPUTS = {
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal* c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal*",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice* o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity* l_extendedprice* l_discount* l_tax* l_returnflag l_linestatus l_shipdate",
}


def _digest(table: str, columns: str) -> str:
    texts = [f"round({c[:-1]} * 1000000)::BIGINT" if c.endswith("*") else c for c in columns.split()]
    row = "md5(concat_ws('|', " + ", ".join(f"coalesce(({t})::VARCHAR, '~')" for t in texts) + "))"
    parts = [f"sum(('0x' || substr(h, {at}, 8))::BIGINT)::BIGINT AS {name}" for at, name in ((1, "digest_high"), (9, "digest_low"))]
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, {', '.join(parts)} FROM (SELECT {row} AS h FROM {table})"


SQL["table_fingerprints"] = (
    "SELECT *, md5(concat_ws('|', n_rows, digest_high, digest_low)) AS digest FROM (" + " UNION ALL ".join(_digest(t, c) for t, c in _INPUTS.items()) + ")"
)
