"""The 55-column feature matrix.

Built in three stages over one (entity, day) order: trailing totals, then levels from them, then
expanding statistics of the 28-day levels.  Spark puts each entity's days in order behind one
exchange; the stages then run on arrays of whole entities (``trailing``).
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidepanel.functions.numeric import RATIO_DENOMINATOR_FLOOR
from tidepanel.operators import trailing as V
from tidepanel.operators import windows as W
from tidepanel.sources.schemas import PANEL_KEYS, PAYMENT_METHODS

SPANS = [W.WINDOW_SHORT, W.WINDOW_MEDIUM, W.WINDOW_LONG]
#: Days computed on together; an entity with more is computed on whole.
ROWS_AT_ONCE = 1 << 15

# Rate metric -> (numerator, denominator) for the volume-weighted rates.
RATES = {
    "refund_rate": ("refund_count", "transaction_count"),
    "chargeback_rate": ("chargeback_count", "transaction_count"),
    "new_customer_rate": ("new_customers", "customer_count"),
}
VELOCITY_RATES = ["chargeback_rate", "refund_rate", "fulfillment_on_time_rate"]
DEVIATIONS = ["chargeback_rate", "refund_rate", "gmv", "fulfillment_on_time_rate", "new_customer_rate", "liquidity"]

# Provenance tag of every feature.
LEAKAGE_STATUS = "causal (uses only merchant_id, day_index<=t) — safe"

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("definition", T.StringType()),
        T.StructField("source_columns", T.ArrayType(T.StringType())),
        T.StructField("window", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("leakage_status", T.StringType()),
    ]
)


def manifest() -> list[dict]:
    """Feature metadata in column order."""
    rows: list[dict] = []

    def add(name, group, definition, sources, window, kind):
        rows.append(
            dict(
                name=name,
                group=group,
                definition=definition,
                source_columns=sources,
                window=window,
                kind=kind,
                leakage_status=LEAKAGE_STATUS,
            )
        )

    mix = [f"pct_pay_{m}" for m in PAYMENT_METHODS] + ["gmv"]
    point = "n/a (point-in-time)"
    for w in SPANS:
        add(f"payment_mix_hhi_{w}d", "payment_behavior", f"Concentration (sum of squared gmv-weighted method shares) over {w} days.", mix, f"{w}d", "level")
    for a, b in ((7, 28), (28, 60)):
        add(f"payment_mix_l1_drift_{a}v{b}", "payment_behavior", f"Total absolute change in method shares, {a} against {b} days.", mix, f"{a}d vs {b}d", "ratio")

    def rate_levels(metric, group, verb):
        num, den = RATES[metric]
        for w in SPANS:
            add(f"{metric}_{w}d", group, f"{verb} over {w} days: sum({num}) / sum({den}).", [num, den], f"{w}d", "level")

    for metric, group, stem in (("refund_rate", "refund_behavior", "refund"), ("chargeback_rate", "chargeback_behavior", "chargeback")):
        rate_levels(metric, group, f"Volume-weighted {stem} rate")
        add(f"{stem}_amount_to_gmv_28d", group, f"Amount-weighted {stem} burden: sum({stem}_amount) / sum(gmv), 28 days.", [f"{stem}_amount", "gmv"], "28d", "ratio")
        add(f"{stem}_count_28d", group, f"Number of {stem}s in 28 days.", [f"{stem}_count"], "28d", "level")
    add("days_since_last_chargeback", "chargeback_behavior", f"Days since the last day with a chargeback, at most {W.RECENCY_CAP_DAYS}.", ["chargeback_count", "day_index"], "expanding (capped)", "level")
    for w in SPANS:
        add(f"fulfillment_on_time_rate_{w}d", "fulfillment", f"Transaction-weighted on-time rate over {w} days.", ["fulfillment_on_time_rate", "transaction_count"], f"{w}d", "level")
    add("fulfillment_delay_avg_days_28d", "fulfillment", "Transaction-weighted delay in days over 28 days.", ["fulfillment_delay_avg_days", "transaction_count"], "28d", "level")
    rate_levels("new_customer_rate", "customer_mix", "Share of new customers")
    add("customer_count_28d", "customer_mix", "Mean daily customers over 28 days.", ["customer_count"], "28d", "level")
    add("liquidity_balance_28d", "financial_state", "Mean daily liquidity over 28 days.", ["liquidity_balance"], "28d", "level")
    add("liquidity_to_gmv_ratio_28d", "financial_state", "Mean liquidity in days of mean gmv, 28 days.", ["liquidity_balance", "gmv"], "28d", "ratio")
    add("pending_settlement_to_gmv_28d", "financial_state", "Mean pending settlement over mean gmv, 28 days.", ["pending_settlement_amount", "gmv"], "28d", "ratio")
    add("liquidity_coefficient_of_variation_28d", "financial_state", "Deviation over mean of liquidity, 28 days.", ["liquidity_balance"], "28d", "ratio")
    add("gmv_level_28d", "merchant_behavior", "Mean daily gmv over 28 days.", ["gmv"], "28d", "level")
    add("transaction_count_level_28d", "merchant_behavior", "Mean daily transactions over 28 days.", ["transaction_count"], "28d", "level")
    add("gmv_coefficient_of_variation_28d", "merchant_behavior", "Deviation over mean of gmv, 28 days.", ["gmv"], "28d", "ratio")
    add("merchant_tenure_days", "merchant_behavior", "Days from signup to the observation date.", ["date (daily_observations)", "signup_date (merchants)"], point, "level")
    add("is_weekend", "merchant_behavior", "1 on Saturday and Sunday.", ["date"], point, "level")
    for wave in ("sin", "cos"):
        add(f"day_of_year_{wave}", "merchant_behavior", f"{wave}(2*pi*day_of_year/365.25).", ["date"], point, "level")
    for metric in VELOCITY_RATES:
        sources = list(RATES.get(metric, ("fulfillment_on_time_rate", "transaction_count")))
        for a, b in ((7, 28), (28, 60)):
            add(f"{metric}_velocity_{a}v{b}", "temporal_velocity", f"{metric}: {a}-day less {b}-day level.", sources, f"{a}d vs {b}d", "velocity")
        add(f"{metric}_acceleration", "temporal_velocity", f"{metric}: short velocity less long velocity.", sources, "7d/28d/60d composite", "acceleration")
    for a, b in ((7, 28), (28, 60)):
        add(f"gmv_velocity_{a}v{b}", "temporal_velocity", f"Relative growth of mean gmv, {a} against {b} days.", ["gmv"], f"{a}d vs {b}d", "velocity")
    add("gmv_acceleration", "temporal_velocity", "gmv: short velocity less long velocity.", ["gmv"], "7d/28d/60d composite", "acceleration")
    add("transaction_count_velocity_7v28", "temporal_velocity", "Relative growth of mean transactions, 7 against 28 days.", ["transaction_count"], "7d vs 28d", "velocity")
    add("new_customer_rate_velocity_7v28", "temporal_velocity", "new_customer_rate: 7-day less 28-day level.", ["new_customers", "customer_count"], "7d vs 28d", "velocity")
    for metric in DEVIATIONS:
        source = "liquidity_balance" if metric == "liquidity" else metric
        add(f"{metric}_deviation_z", "deviation_from_baseline", f"7-day {source} against this merchant's own history of its 28-day level, in deviations.", [source], "7d vs expanding(28d-smoothed)", "deviation")
    return rows


def feature_columns() -> list[str]:
    return [row["name"] for row in manifest()]


def manifest_df(spark) -> DataFrame:
    rows = [tuple(row[f.name] for f in MANIFEST_SCHEMA) for row in manifest()]
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)


def _measured(column: dict[str, V.Values], scale: dict[str, int], exact_money: bool) -> dict[tuple[str, int], V.Values]:
    """Trailing sums as doubles by (measure, days); integers and exact money through running totals."""
    txn, gmv = column["transaction_count"].double(), column["gmv"].double() / float(scale["gmv"])

    def by_method(share: V.Values) -> V.Values:
        amount = share * gmv
        if not exact_money:
            return amount
        # With exact money the amount paid by one method is a whole number of cents.
        cents = amount * 100.0
        if not (np.abs(cents.filled()) < 2.0**63).all():
            raise OverflowError("an amount paid by one method does not fit a long")
        whole = np.copysign(np.floor(np.abs(cents.filled()) + 0.5), cents.filled())
        return V.Values(whole.astype(np.int64), cents.given)

    mid = [W.WINDOW_MEDIUM]
    short_mid = [W.WINDOW_SHORT, W.WINDOW_MEDIUM]
    measures = {
        "txn": ("transaction_count", SPANS),
        "refunds": ("refund_count", SPANS),
        "chargebacks": ("chargeback_count", SPANS),
        "new": ("new_customers", SPANS),
        "customers": ("customer_count", SPANS),
        "gmv_sum": ("gmv", SPANS),
        "refund_amt": ("refund_amount", mid),
        "chargeback_amt": ("chargeback_amount", mid),
        "liquidity": ("liquidity_balance", short_mid),
        "pending": ("pending_settlement_amount", mid),
        "on_time": (column["fulfillment_on_time_rate"] * txn, SPANS),
        "delay": (column["fulfillment_delay_avg_days"] * txn, mid),
        **{f"pay_{m}": (by_method(column[f"pct_pay_{m}"]), SPANS) for m in PAYMENT_METHODS},
    }
    sums = {}
    for name, (measure, spans) in measures.items():
        values, units = (column[measure], scale[measure]) if isinstance(measure, str) else (measure, 1)
        if values.x.dtype.kind == "i":
            total = V.running(values)
            sums |= {(name, w): V.between(total, w).double() / float(units) for w in spans}
        else:
            sums |= {(name, w): V.trailing_sum(values, w) for w in spans}
    return sums


def _computed(column: dict[str, V.Values], scale: dict[str, int], exact_money: bool) -> dict[str, V.Values]:
    """The 55 features of whole entities."""
    sums = _measured(column, scale, exact_money)
    method_unit = 100.0 if exact_money else 1.0
    places = np.arange(1, column["gmv"].x.shape[1] + 1)

    def mean(name: str, w: int) -> V.Values:
        return sums[name, w] / np.minimum(places, w)

    def over(num: V.Values, den: V.Values) -> V.Values:
        return num / den.floored(RATIO_DENOMINATOR_FLOOR)

    def growth(short: V.Values, long: V.Values) -> V.Values:
        return over(short, long) - 1.0

    out: dict[str, V.Values] = {}
    for metric, (num, den) in (("refund_rate", ("refunds", "txn")), ("chargeback_rate", ("chargebacks", "txn")), ("new_customer_rate", ("new", "customers")), ("fulfillment_on_time_rate", ("on_time", "txn"))):
        for w in SPANS:
            out[f"{metric}_{w}d"] = over(sums[num, w], sums[den, w])
    gmv_mean = {w: mean("gmv_sum", w) for w in SPANS}
    txn_mean = {w: mean("txn", w) for w in (7, 28)}
    liquidity_mean = {w: mean("liquidity", w) for w in (7, 28)}

    shares = {w: [over(sums[f"pay_{m}", w] / method_unit, sums["gmv_sum", w]) for m in PAYMENT_METHODS] for w in SPANS}
    for w in SPANS:
        out[f"payment_mix_hhi_{w}d"] = W.hhi(shares[w])
    for x, y in ((7, 28), (28, 60)):
        out[f"payment_mix_l1_drift_{x}v{y}"] = reduce(operator.add, [abs(s - t) for s, t in zip(shares[x], shares[y])])
    for stem, total in (("refund", "refunds"), ("chargeback", "chargebacks")):
        out[f"{stem}_amount_to_gmv_28d"] = over(sums[f"{stem}_amt", 28], sums["gmv_sum", 28])
        out[f"{stem}_count_28d"] = sums[total, 28]
    out["days_since_last_chargeback"] = V.days_since_last_positive(column["chargeback_count"], column["_day"], W.RECENCY_CAP_DAYS)
    out["fulfillment_delay_avg_days_28d"] = over(sums["delay", 28], sums["txn", 28])
    out["customer_count_28d"] = mean("customers", 28)
    out["liquidity_balance_28d"] = liquidity_mean[28]
    out["liquidity_to_gmv_ratio_28d"] = over(liquidity_mean[28], gmv_mean[28])
    out["pending_settlement_to_gmv_28d"] = over(mean("pending", 28), gmv_mean[28])
    for name, money, level in (("liquidity", "liquidity_balance", liquidity_mean[28]), ("gmv", "gmv", gmv_mean[28])):
        deviation = V.trailing_std(column[money].double() / float(scale[money]), 28)
        out[f"{name}_coefficient_of_variation_28d"] = over(deviation, level)
    out["gmv_level_28d"] = gmv_mean[28]
    out["transaction_count_level_28d"] = txn_mean[28]
    out["merchant_tenure_days"] = column["_tenure"].double()
    out["is_weekend"] = V.Values(((column["_date"].x + 3) % 7 >= 5).astype(np.float64), column["_date"].given)
    days = column["_date"].x.astype("M8[D]")
    day_of_year = (days - days.astype("M8[Y]").astype("M8[D]")).astype(np.int64) + 1
    angle = 2 * math.pi * day_of_year.astype(np.float64) / 365.25
    out["day_of_year_sin"] = V.Values(np.sin(angle), column["_date"].given)
    out["day_of_year_cos"] = V.Values(np.cos(angle), column["_date"].given)

    def velocities(metric: str, short: V.Values, long: V.Values) -> None:
        out[f"{metric}_velocity_7v28"] = short
        out[f"{metric}_velocity_28v60"] = long
        out[f"{metric}_acceleration"] = short - long

    for metric in VELOCITY_RATES:
        velocities(metric, out[f"{metric}_7d"] - out[f"{metric}_28d"], out[f"{metric}_28d"] - out[f"{metric}_60d"])
    velocities("gmv", growth(gmv_mean[7], gmv_mean[28]), growth(gmv_mean[28], gmv_mean[60]))
    out["transaction_count_velocity_7v28"] = growth(txn_mean[7], txn_mean[28])
    out["new_customer_rate_velocity_7v28"] = out["new_customer_rate_7d"] - out["new_customer_rate_28d"]
    smoothed = {
        **{m: (out[f"{m}_7d"], out[f"{m}_28d"]) for m in DEVIATIONS if m not in ("gmv", "liquidity")},
        "gmv": (gmv_mean[7], gmv_mean[28]),
        "liquidity": (liquidity_mean[7], liquidity_mean[28]),
    }
    for m, (current, base) in smoothed.items():
        history, deviation = V.expanding(base)
        out[f"{m}_deviation_z"] = ((current - history) / deviation.floored(W.STD_FLOOR)).clipped(-W.Z_SCORE_CLIP, W.Z_SCORE_CLIP)
    return out


def _array(column: pa.Array, fill: int = 0) -> V.Values:
    """A flat column; decimals of up to 18 digits as the integers they are made of."""
    given = None if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_decimal(column.type):
        x = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset : 2 * (column.offset + len(column)) : 2]
    else:
        x = (column.fill_null(fill) if column.null_count else column).to_numpy(zero_copy_only=False)
    return V.Values(x, given)


def _entities(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Spans (first, end) of neighbouring entities: not much more places than rows once filled to one length."""
    lengths = np.diff(np.append(starts, n)).tolist()
    first, longest, rows = 0, 0, 0
    for k, length in enumerate(lengths):
        most = max(longest, length)
        if k > first and ((k - first + 1) * most > 2 * (rows + length) + 4096 or rows + length > ROWS_AT_ONCE):
            yield first, k
            first, most, rows = k, length, 0
        longest, rows = most, rows + length
    if lengths:
        yield first, len(lengths)


def _feature_batches(table: pa.Table, starts: np.ndarray, scale: dict[str, int], exact_money: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Key columns and features of whole entities, whose first rows are ``starts``."""
    ends = np.append(starts, table.num_rows)
    for first, end in _entities(starts, table.num_rows):
        part = table.slice(ends[first], ends[end] - ends[first]).combine_chunks()
        lengths = np.diff(ends[first : end + 1])
        inside = np.arange(lengths.max()) < lengths[:, None]
        even = bool(inside.all())

        def shaped(x: np.ndarray) -> np.ndarray:
            if even:
                return x.reshape(inside.shape)
            out = np.zeros(inside.shape, x.dtype)
            out[inside] = x
            return out

        def flat(x: np.ndarray) -> np.ndarray:
            return x.reshape(-1) if even else x[inside]

        column = {}
        for name in part.column_names:
            if name not in (*PANEL_KEYS, "_place"):
                found = _array(part[name].chunk(0))
                column[name] = V.Values(shaped(found.x), None if found.given is None else shaped(found.given))
        with np.errstate(all="ignore"):
            made = _computed(column, scale, exact_money)
        arrays = [part[c].chunk(0) for c in PANEL_KEYS]
        for name in schema.names[len(PANEL_KEYS) :]:
            v = made[name]
            arrays.append(pa.array(flat(v.x), pa.float64(), mask=None if v.given is None else ~flat(v.given)))
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _plain(daily: DataFrame, name: str) -> tuple[Column, int]:
    """A numeric column as a long, a decimal of up to 18 digits or a double, and how many of its units make one."""
    kind = daily.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long"), 1
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return F.col(name), 10**kind.scale
    return F.col(name).cast("double"), 1


def build_features(daily: DataFrame, dimension: DataFrame) -> DataFrame:
    """(merchant_id, date, day_index) + 55 features.  Only id and signup date are read from the dimension.

    Spark orders the days of each entity, which a numbering asks for; the features of whole entities, some
    ``ROWS_AT_ONCE`` days together, are then computed on arrays.  One entity's days fit a task.
    """
    exact_money = isinstance(daily.schema["gmv"].dataType, T.DecimalType)
    plain = {n: _plain(daily, n) for n in SOURCE_COLUMNS}
    scale = {n: units for n, (_, units) in plain.items()}
    source = daily.join(dimension.select("merchant_id", "signup_date"), "merchant_id", "left").select(
        *PANEL_KEYS,
        *[c.alias(n) for n, (c, _) in plain.items()],
        F.datediff("date", "signup_date").alias("_tenure"),
        F.unix_date(F.to_date("date")).cast("long").alias("_date"),
        F.col("day_index").cast("long").alias("_day"),
    ).withColumn("_place", F.row_number().over(W.entity_order()))
    schema = T.StructType([*[daily.schema[k] for k in PANEL_KEYS], *[T.StructField(n, T.DoubleType()) for n in feature_columns()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held, rows, enough = [], 0, ROWS_AT_ONCE
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(table["_place"].to_numpy() == 1)
            last = int(starts[-1])
            yield from _feature_batches(table.slice(0, last), starts[:-1], scale, exact_money, arrow)
            held, rows = table.slice(last).to_batches(), table.num_rows - last
            enough = max(ROWS_AT_ONCE, 2 * rows)
        if rows:
            table = pa.Table.from_batches(held)
            yield from _feature_batches(table, np.flatnonzero(table["_place"].to_numpy() == 1), scale, exact_money, arrow)

    return source.mapInArrow(run, schema)


# Panel columns the features are computed from.
SOURCE_COLUMNS = [
    "gmv",
    "transaction_count",
    "refund_count",
    "refund_amount",
    "chargeback_count",
    "chargeback_amount",
    "fulfillment_delay_avg_days",
    "fulfillment_on_time_rate",
    "customer_count",
    "new_customers",
    "liquidity_balance",
    "pending_settlement_amount",
    *[f"pct_pay_{m}" for m in PAYMENT_METHODS],
]
