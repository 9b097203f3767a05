"""Shared common table expressions and the WITH-clause composer."""

from __future__ import annotations

METHODS = {
    "card": "1-URGENT",
    "upi": "2-HIGH",
    "netbanking": "3-MEDIUM",
    "wallet": "4-NOT SPECIFIED",
    "bnpl": "5-LOW",
}
SPANS = (7, 28, 60)

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (deps, body)


def with_(select: str, *needs: str) -> str:
    """Prefix ``select`` with every expression it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return select
    if select.startswith(", "):
        return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered) + select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered) + "\n" + select


def fx(expr: str, digits: int = 6) -> str:
    """Half-up rounding by plain floating-point arithmetic; larger values have no such digits."""
    s = float(10**digits)
    return f"(CASE WHEN abs({expr}) < {2.0**53 / s!r} THEN floor(({expr}) * {s!r} + 0.500001) / {s!r} ELSE ({expr})::DOUBLE END)"


def fixed_list(names, digits: int = 6) -> str:
    return ", ".join(f"{fx(n, digits)} AS {n}" for n in names)


def floor_ratio(num: str, den: str, floor: str = "1.0") -> str:
    return f"(({num})::DOUBLE / CASE WHEN ({den}) IS NULL THEN NULL ELSE greatest(({den})::DOUBLE, {floor}) END)"


def _panel(level: str) -> None:
    key, fmt = {
        "nation": ("s_nationkey", "'NAT' || lpad(({k})::VARCHAR, 2, '0')"),
        "supplier": ("s_suppkey", "'SUP' || lpad(({k})::VARCHAR, 9, '0')"),
    }[level]
    p = "" if level == "nation" else "s_"
    pays = ", ".join(f"sum(CASE WHEN prio = '{v}' THEN net ELSE 0 END) AS pay_{m}" for m, v in METHODS.items())
    sums = ["lines", "gmv", "refunds", "refund_cents", "chargebacks", "chargeback_cents", "on_time", "quantity"]
    sums += [f"pay_{m}" for m in METHODS]
    cte(
        f"{p}lines",
        f"""SELECT {key} AS entity, o_custkey AS customer, l_shipdate::DATE AS day,
            (CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) + 50) // 100 AS net,
            CAST(l_quantity AS BIGINT) AS quantity, l_returnflag AS flag, l_linestatus AS status, o_orderpriority AS prio
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    )
    cte(
        f"{p}customer_first",
        f"SELECT entity, customer, min(day) AS first_day FROM {p}lines GROUP BY ALL",
        f"{p}lines",
    )
    cte(
        f"{p}cells",
        f"""SELECT l.entity, l.day, count(*) AS lines, sum(net)::BIGINT AS gmv,
            count(*) FILTER (WHERE flag = 'R') AS refunds, sum(CASE WHEN flag = 'R' THEN net ELSE 0 END)::BIGINT AS refund_cents,
            count(*) FILTER (WHERE flag = 'A') AS chargebacks, sum(CASE WHEN flag = 'A' THEN net ELSE 0 END)::BIGINT AS chargeback_cents,
            count(*) FILTER (WHERE status = 'F') AS on_time, sum(quantity)::BIGINT AS quantity, {pays},
            count(DISTINCT l.customer) AS customers,
            count(DISTINCT CASE WHEN l.day = f.first_day THEN l.customer END) AS new_customers
        FROM {p}lines l JOIN {p}customer_first f ON l.entity = f.entity AND l.customer = f.customer GROUP BY l.entity, l.day""",
        f"{p}lines",
        f"{p}customer_first",
    )
    cte(
        f"{p}calendar",
        f"""SELECT e.entity, d.day, date_diff('day', b.lo, d.day) AS day_index
        FROM (SELECT DISTINCT entity FROM {p}cells) e,
             (SELECT min(l_shipdate)::DATE AS lo, max(l_shipdate)::DATE AS hi FROM lineitem) b,
             (SELECT unnest(generate_series(min(l_shipdate)::DATE, max(l_shipdate)::DATE, INTERVAL 1 DAY))::DATE AS day FROM lineitem) d""",
        f"{p}cells",
    )
    zero = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in [*sums, "customers", "new_customers"])
    cte(
        f"{p}dense",
        f"""SELECT c.entity, c.day, c.day_index, {zero}
        FROM {p}calendar c LEFT JOIN {p}cells x ON c.entity = x.entity AND c.day = x.day""",
        f"{p}calendar",
        f"{p}cells",
    )

    def rate(num: str, den: str) -> str:
        return f"CASE WHEN {den} > 0 THEN ({num})::DOUBLE / ({den})::DOUBLE ELSE 0.0 END"

    def recent(n: int) -> str:
        return (
            "greatest(sum(gmv - refund_cents - chargeback_cents) OVER "
            f"(PARTITION BY entity ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0)::BIGINT"
        )

    # Money stays in integer cents here; m() turns it into currency units.
    cte(
        f"{p}panel",
        f"""SELECT {fmt.format(k='entity')} AS merchant_id, day AS date, day_index, gmv AS gmv_c, lines AS transaction_count,
            {rate('gmv / 100.0', 'lines')} AS aov, refunds AS refund_count, refund_cents AS refund_c, {rate('refunds', 'lines')} AS refund_rate,
            chargebacks AS chargeback_count, chargeback_cents AS chargeback_c, {rate('chargebacks', 'lines')} AS chargeback_rate,
            {rate('quantity', 'lines * 10')} AS fulfillment_delay_avg_days, {rate('on_time', 'lines')} AS fulfillment_on_time_rate,
            customers AS customer_count, new_customers, customers - new_customers AS returning_customers,
            {rate('new_customers', 'customers')} AS new_customer_rate,
            {', '.join(f"{rate(f'pay_{m}', 'gmv')} AS pct_pay_{m}" for m in METHODS)},
            {', '.join(f'pay_{m}' for m in METHODS)}, on_time, quantity,
            {recent(7)} AS liquidity_c, {recent(3)} AS pending_c,
            gmv / 100.0 AS gmv, refund_cents / 100.0 AS refund_amount, chargeback_cents / 100.0 AS chargeback_amount,
            {recent(7)} / 100.0 AS liquidity_balance, {recent(3)} / 100.0 AS pending_settlement_amount
        FROM {p}dense""",
        f"{p}dense",
    )
    cte(
        f"{p}dimension",
        f"""SELECT {fmt.format(k=key)} AS merchant_id, r_name AS archetype,
            CASE ((rank() OVER (ORDER BY bal) - 1) * 3) // count(*) OVER () WHEN 0 THEN 'small' WHEN 1 THEN 'mid' ELSE 'large' END AS business_tier,
            (DATE '1995-01-01' - CAST(60 + 10 * s_nationkey AS INTEGER))::DATE AS signup_date,
            CASE WHEN s_nationkey % 2 = 0 THEN 'weekend_heavy' ELSE 'weekday_heavy' END AS weekly_seasonality_profile
        FROM (SELECT {key}, s_nationkey, sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS bal FROM supplier GROUP BY ALL)
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    )

    # Features: direct frames over integer measures (the library uses running totals).
    w = {n: f"(PARTITION BY merchant_id ORDER BY day_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in SPANS}

    def tsum(expr: str, n: int) -> str:
        return f"sum({expr}) OVER {w[n]}::DOUBLE" if False else f"(sum({expr}) OVER {w[n]})::DOUBLE"

    cols: list[str] = []
    for name, expr, spans in [
        ("txn", "transaction_count", SPANS),
        ("refunds", "refund_count", SPANS),
        ("chargebacks", "chargeback_count", SPANS),
        ("new", "new_customers", SPANS),
        ("customers", "customer_count", SPANS),
        ("gmv", "gmv_c", SPANS),
        ("refund_amt", "refund_c", (28,)),
        ("chargeback_amt", "chargeback_c", (28,)),
        ("liquidity", "liquidity_c", (7, 28)),
        ("pending", "pending_c", (28,)),
        ("ontime", "fulfillment_on_time_rate * transaction_count", SPANS),
        ("delay", "fulfillment_delay_avg_days * transaction_count", (28,)),
        *[(f"pay_{m}", f"pay_{m}", SPANS) for m in METHODS],
    ]:
        money = name in ("gmv", "refund_amt", "chargeback_amt", "liquidity", "pending") or name.startswith("pay_")
        for n in spans:
            cols.append(f"{tsum(expr, n)}{' / 100.0' if money else ''} AS {name}_{n}")
    cols += [f"(count(*) OVER {w[n]}) AS n_{n}" for n in SPANS]
    cols.append(f"coalesce(stddev_samp(gmv) OVER {w[28]}, 0) AS gmv_std")
    cols.append(f"coalesce(stddev_samp(liquidity_balance) OVER {w[28]}, 0) AS liq_std")
    so_far = "(PARTITION BY merchant_id ORDER BY day_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols.append(f"max(CASE WHEN chargeback_count > 0 THEN day_index END) OVER {so_far} AS last_cb")
    cte(f"{p}totals", f"SELECT merchant_id, date, day_index, {', '.join(cols)} FROM {p}panel", f"{p}panel")

    lv: list[str] = []
    for m, (a, b) in {
        "refund_rate": ("refunds", "txn"),
        "chargeback_rate": ("chargebacks", "txn"),
        "new_customer_rate": ("new", "customers"),
        "fulfillment_on_time_rate": ("ontime", "txn"),
    }.items():
        lv += [f"{floor_ratio(f'{a}_{n}', f'{b}_{n}')} AS {m}_{n}d" for n in SPANS]
    for n in SPANS:
        lv.append(f"gmv_{n} / n_{n} AS gmv_mean_{n}")
        lv += [f"{floor_ratio(f'pay_{m}_{n}', f'gmv_{n}')} AS share_{m}_{n}" for m in METHODS]
    lv += ["txn_7 / n_7 AS txn_mean_7", "txn_28 / n_28 AS txn_mean_28"]
    lv += ["liquidity_7 / n_7 AS liq_mean_7", "liquidity_28 / n_28 AS liq_mean_28"]
    cte(f"{p}levels", f"SELECT *, {', '.join(lv)} FROM {p}totals", f"{p}totals")

    dev = {
        "chargeback_rate": ("chargeback_rate_7d", "chargeback_rate_28d"),
        "refund_rate": ("refund_rate_7d", "refund_rate_28d"),
        "gmv": ("gmv_mean_7", "gmv_mean_28"),
        "fulfillment_on_time_rate": ("fulfillment_on_time_rate_7d", "fulfillment_on_time_rate_28d"),
        "new_customer_rate": ("new_customer_rate_7d", "new_customer_rate_28d"),
        "liquidity": ("liq_mean_7", "liq_mean_28"),
    }
    hist = [f"avg({b}) OVER {so_far} AS {m}_hm, coalesce(stddev_samp({b}) OVER {so_far}, 0) AS {m}_hs" for m, (_, b) in dev.items()]
    cte(f"{p}history", f"SELECT *, {', '.join(hist)} FROM {p}levels", f"{p}levels")

    f: list[str] = [
        *[f"{' + '.join(f'share_{m}_{n} * share_{m}_{n}' for m in METHODS)} AS payment_mix_hhi_{n}d" for n in SPANS],
        *[
            f"{' + '.join(f'abs(share_{m}_{a} - share_{m}_{b})' for m in METHODS)} AS payment_mix_l1_drift_{a}v{b}"
            for a, b in ((7, 28), (28, 60))
        ],
        "refund_rate_7d, refund_rate_28d, refund_rate_60d",
        f"{floor_ratio('refund_amt_28', 'gmv_28')} AS refund_amount_to_gmv_28d",
        "refunds_28 AS refund_count_28d",
        "chargeback_rate_7d, chargeback_rate_28d, chargeback_rate_60d",
        f"{floor_ratio('chargeback_amt_28', 'gmv_28')} AS chargeback_amount_to_gmv_28d",
        "chargebacks_28 AS chargeback_count_28d",
        "least(coalesce(h.day_index - last_cb, 90), 90)::DOUBLE AS days_since_last_chargeback",
        "fulfillment_on_time_rate_7d, fulfillment_on_time_rate_28d, fulfillment_on_time_rate_60d",
        f"{floor_ratio('delay_28', 'txn_28')} AS fulfillment_delay_avg_days_28d",
        "new_customer_rate_7d, new_customer_rate_28d, new_customer_rate_60d",
        "customers_28 / n_28 AS customer_count_28d",
        "liq_mean_28 AS liquidity_balance_28d",
        f"{floor_ratio('liq_mean_28', 'gmv_mean_28')} AS liquidity_to_gmv_ratio_28d",
        f"{floor_ratio('pending_28 / n_28', 'gmv_mean_28')} AS pending_settlement_to_gmv_28d",
        f"{floor_ratio('liq_std', 'liq_mean_28')} AS liquidity_coefficient_of_variation_28d",
        "gmv_mean_28 AS gmv_level_28d",
        "txn_mean_28 AS transaction_count_level_28d",
        f"{floor_ratio('gmv_std', 'gmv_mean_28')} AS gmv_coefficient_of_variation_28d",
        "date_diff('day', signup_date, date)::DOUBLE AS merchant_tenure_days",
        "CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend",
        "sin(2 * pi() * dayofyear(date)::DOUBLE / 365.25::DOUBLE) AS day_of_year_sin",
        "cos(2 * pi() * dayofyear(date)::DOUBLE / 365.25::DOUBLE) AS day_of_year_cos",
    ]
    for m in ("chargeback_rate", "refund_rate", "fulfillment_on_time_rate"):
        f += [
            f"{m}_7d - {m}_28d AS {m}_velocity_7v28",
            f"{m}_28d - {m}_60d AS {m}_velocity_28v60",
            f"({m}_7d - {m}_28d) - ({m}_28d - {m}_60d) AS {m}_acceleration",
        ]
    gv = lambda a, b: f"({floor_ratio(f'gmv_mean_{a}', f'gmv_mean_{b}')} - 1.0)"
    f += [
        f"{gv(7, 28)} AS gmv_velocity_7v28",
        f"{gv(28, 60)} AS gmv_velocity_28v60",
        f"{gv(7, 28)} - {gv(28, 60)} AS gmv_acceleration",
        f"{floor_ratio('txn_mean_7', 'txn_mean_28')} - 1.0 AS transaction_count_velocity_7v28",
        "new_customer_rate_7d - new_customer_rate_28d AS new_customer_rate_velocity_7v28",
    ]
    f += [
        f"least(greatest(({a} - {m}_hm) / greatest({m}_hs, 0.0001::DOUBLE), -10.0::DOUBLE), 10.0::DOUBLE) AS {m}_deviation_z"
        for m, (a, _) in dev.items()
    ]
    cte(
        f"{p}features",
        f"SELECT h.merchant_id, h.date, h.day_index, {', '.join(f)} FROM {p}history h LEFT JOIN {p}dimension d ON h.merchant_id = d.merchant_id",
        f"{p}history",
        f"{p}dimension",
    )

    # Labels: direct past and future frames.
    arms = []
    for h in (7, 14, 30):
        fut = f"(PARTITION BY merchant_id ORDER BY day_index ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        past = "(PARTITION BY merchant_id ORDER BY day_index ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)"
        arms.append(
            f"""SELECT merchant_id, date AS as_of_date, (row_number() OVER (PARTITION BY merchant_id ORDER BY day_index) - 1) AS day_index, {h}::BIGINT AS horizon_days,
            count(*) OVER {fut} AS n_future, (sum(chargeback_c) OVER {fut})::DOUBLE / 100.0 AS fut_amt, sum(chargeback_count) OVER {fut} AS fut_cnt,
            sum(transaction_count) OVER {fut} AS fut_txn, count(*) OVER {past} AS n_past, (sum(gmv_c) OVER {past})::DOUBLE / 100.0 AS past_gmv,
            (sum(chargeback_c) OVER {past})::DOUBLE / 100.0 AS past_amt, sum(chargeback_count) OVER {past} AS past_cnt, sum(transaction_count) OVER {past} AS past_txn
            FROM {p}panel"""
        )
    cte(f"{p}label_sums", " UNION ALL ".join(arms), f"{p}panel")
    cte(
        f"{p}label_rates",
        f"""SELECT *, past_gmv / n_past AS gmv_base, past_amt / n_past AS amt_base,
            CASE WHEN past_txn > 0 THEN past_cnt::DOUBLE / past_txn ELSE 0.0 END AS rate_base,
            CASE WHEN fut_txn > 0 THEN fut_cnt::DOUBLE / fut_txn ELSE 0.0 END AS fut_rate
        FROM {p}label_sums WHERE n_future = horizon_days""",
        f"{p}label_sums",
    )
    cte(
        f"{p}labels_t",
        f"""SELECT merchant_id, as_of_date, day_index, horizon_days, fut_amt AS future_chargeback_amount, fut_rate AS future_chargeback_rate,
            fut_txn::BIGINT AS future_transaction_count, gmv_base AS baseline_daily_gmv_trailing, amt_base AS baseline_daily_chargeback_amount_trailing,
            rate_base AS baseline_chargeback_rate_trailing, fut_amt / greatest(amt_base * horizon_days, 1.0::DOUBLE) AS elevation_ratio_amount,
            fut_rate / greatest(rate_base, 0.0001::DOUBLE) AS elevation_ratio_rate,
            CASE WHEN fut_amt / greatest(amt_base * horizon_days, 1.0::DOUBLE) >= 1.75
                  AND fut_amt >= greatest(50.0::DOUBLE, gmv_base * horizon_days * 0.0005::DOUBLE) THEN 1 ELSE 0 END::BIGINT AS label_elevated_chargeback
        FROM {p}label_rates""",
        f"{p}label_rates",
    )


_panel("nation")
_panel("supplier")

FEATURES = [
    "payment_mix_hhi_7d", "payment_mix_hhi_28d", "payment_mix_hhi_60d", "payment_mix_l1_drift_7v28", "payment_mix_l1_drift_28v60",
    "refund_rate_7d", "refund_rate_28d", "refund_rate_60d", "refund_amount_to_gmv_28d", "refund_count_28d",
    "chargeback_rate_7d", "chargeback_rate_28d", "chargeback_rate_60d", "chargeback_amount_to_gmv_28d", "chargeback_count_28d",
    "days_since_last_chargeback", "fulfillment_on_time_rate_7d", "fulfillment_on_time_rate_28d", "fulfillment_on_time_rate_60d",
    "fulfillment_delay_avg_days_28d", "new_customer_rate_7d", "new_customer_rate_28d", "new_customer_rate_60d", "customer_count_28d",
    "liquidity_balance_28d", "liquidity_to_gmv_ratio_28d", "pending_settlement_to_gmv_28d", "liquidity_coefficient_of_variation_28d",
    "gmv_level_28d", "transaction_count_level_28d", "gmv_coefficient_of_variation_28d", "merchant_tenure_days", "is_weekend",
    "day_of_year_sin", "day_of_year_cos", "chargeback_rate_velocity_7v28", "chargeback_rate_velocity_28v60", "chargeback_rate_acceleration",
    "refund_rate_velocity_7v28", "refund_rate_velocity_28v60", "refund_rate_acceleration", "fulfillment_on_time_rate_velocity_7v28",
    "fulfillment_on_time_rate_velocity_28v60", "fulfillment_on_time_rate_acceleration", "gmv_velocity_7v28", "gmv_velocity_28v60",
    "gmv_acceleration", "transaction_count_velocity_7v28", "new_customer_rate_velocity_7v28", "chargeback_rate_deviation_z",
    "refund_rate_deviation_z", "gmv_deviation_z", "fulfillment_on_time_rate_deviation_z", "new_customer_rate_deviation_z", "liquidity_deviation_z",
]
LABEL_DOUBLES = [
    "future_chargeback_amount", "future_chargeback_rate", "baseline_daily_gmv_trailing", "baseline_daily_chargeback_amount_trailing",
    "baseline_chargeback_rate_trailing", "elevation_ratio_amount", "elevation_ratio_rate",
]
PANEL_DOUBLES = [
    "gmv", "aov", "refund_amount", "refund_rate", "chargeback_amount", "chargeback_rate", "fulfillment_delay_avg_days", "fulfillment_on_time_rate",
    "new_customer_rate", *[f"pct_pay_{m}" for m in METHODS], "liquidity_balance", "pending_settlement_amount",
]
PANEL_LONGS = ["transaction_count", "refund_count", "chargeback_count", "customer_count", "new_customers", "returning_customers"]
SIGNALS = {
    "chargeback_rate_deviation_z": ("chargeback_deterioration", "risk", "", "chargeback_rate"),
    "refund_rate_deviation_z": ("refund_shock", "risk", "", "refund_rate"),
    "fulfillment_on_time_rate_deviation_z": ("fulfillment_degradation", "risk", "-", "fulfillment_on_time_rate,fulfillment_delay_avg_days"),
    "new_customer_rate_deviation_z": ("customer_mix_shift", "risk", "", "new_customer_rate"),
    "gmv_deviation_z": ("festival_growth", "benign_growth", "", "gmv,transaction_count"),
}
cte(
    "flagged",
    " UNION ALL ".join(
        f"SELECT merchant_id, date, day_index, '{t}' AS event_type, '{c}' AS category, '{a}' AS affects, {s}{z} AS z FROM features WHERE {s}{z} >= 2.0"
        for z, (t, c, s, a) in SIGNALS.items()
    ),
    "features",
)
cte(
    "events_t",
    """SELECT 'E-' || merchant_id || '-' || strftime(start_date, '%Y%m%d') || '-' || event_type AS event_id, merchant_id, event_type, category,
        category = 'benign_growth' AS hard_negative, CASE WHEN duration_days >= 3 THEN 'gradual' ELSE 'sudden' END AS shape, start_date, end_date,
        least((end_date + 7)::DATE, (SELECT max(date) FROM panel)) AS recovery_end_date, duration_days, least(peak / 10, 1.0::DOUBLE) AS severity_score, affects,
        replace(event_type, '_', ' ') || ' (' || CASE WHEN duration_days >= 3 THEN 'gradual' ELSE 'sudden' END || ' onset)' AS description
    FROM (SELECT merchant_id, event_type, any_value(category) AS category, any_value(affects) AS affects, min(date) AS start_date, max(date) AS end_date,
              date_diff('day', min(date), max(date)) + 1 AS duration_days, max(z) AS peak
          FROM (SELECT *, day_index - row_number() OVER (PARTITION BY merchant_id, event_type ORDER BY day_index) AS grp FROM flagged)
          GROUP BY merchant_id, event_type, grp)""",
    "flagged",
    "panel",
)
_avg = lambda c: f"avg({c})"
cte(
    "baselines",
    """SELECT merchant_id, (sum(gmv_c)::DOUBLE / 100.0) / count(*) AS baseline_daily_gmv, sum(transaction_count)::DOUBLE / count(*) AS baseline_daily_txn_count,
        CASE WHEN sum(transaction_count) > 0 THEN (sum(gmv_c)::DOUBLE / 100.0) / sum(transaction_count) ELSE 0 END AS baseline_aov,
        CASE WHEN sum(transaction_count) > 0 THEN sum(refund_count)::DOUBLE / sum(transaction_count) ELSE 0 END AS baseline_refund_rate,
        CASE WHEN sum(transaction_count) > 0 THEN sum(chargeback_count)::DOUBLE / sum(transaction_count) ELSE 0 END AS baseline_chargeback_rate,
        avg(fulfillment_delay_avg_days) AS baseline_fulfillment_delay_days, avg(fulfillment_on_time_rate) AS baseline_on_time_rate,
        CASE WHEN sum(customer_count) > 0 THEN sum(new_customers)::DOUBLE / sum(customer_count) ELSE 0 END AS baseline_new_customer_rate, """
    + ", ".join(f"avg(pct_pay_{m}) AS baseline_pct_pay_{m}" for m in METHODS)
    + """, 0.0::DOUBLE AS annual_growth_rate, coalesce(stddev_samp(gmv) / ((sum(gmv_c)::DOUBLE / 100.0) / count(*)), 0) AS volatility_factor,
        7.0::DOUBLE AS liquidity_buffer_days, 3::BIGINT AS settlement_cycle_days FROM panel GROUP BY merchant_id""",
    "panel",
)
cte("merchants", "SELECT * FROM dimension JOIN baselines USING (merchant_id)", "dimension", "baselines")
