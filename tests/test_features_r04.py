"""The feature matrix on arrays: against the window expressions, on entities of any length and with nulls."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import panel
from tidepanel.functions.numeric import ratio_floored
from tidepanel.operators import features as feature_module
from tidepanel.operators import windows as W
from tidepanel.operators.features import build_features, feature_columns
from tidepanel.plans.registry import rounded

MONEY = ["gmv", "refund_amount", "chargeback_amount", "liquidity_balance", "pending_settlement_amount"]


def ragged(spark):
    draw = random.Random(11)

    def maybe(value):
        return None if draw.random() < 0.1 else value

    rows = [
        dict(
            merchant_id=m,
            day_index=i,
            gmv=maybe(draw.randint(0, 99999) / 100),
            transaction_count=maybe(draw.randint(0, 9)),
            refund_count=maybe(draw.randint(0, 3)),
            chargeback_count=maybe(int(draw.random() < 0.05)),
            fulfillment_on_time_rate=maybe(draw.random()),
            liquidity_balance=None if m == "m2" else maybe(draw.randint(0, 9999) / 100),
            pct_pay_card=maybe(draw.random()),
        )
        for m, days in {"m0": 1, "m1": 100, "m2": 3, "m3": 70, "m4": 2, "m5": 65}.items()
        for i in range(days)
    ]
    daily = panel(spark, rows)
    signups = spark.createDataFrame([(f"m{k}", None if k == 3 else "2024-01-01") for k in range(5)], "merchant_id string, signup_date string")
    return daily, signups.withColumn("signup_date", F.col("signup_date").cast("date"))


@pytest.mark.parametrize("money", ["double", "decimal(18,2)"])
def test_arrays_equal_window_expressions(spark, monkeypatch, money):
    monkeypatch.setattr(feature_module, "ROWS_AT_ONCE", 16)
    daily, signups = ragged(spark)
    daily = daily.withColumns({c: F.col(c).cast(money) for c in MONEY})
    measures = {"txn": F.col("transaction_count"), "refunds": F.col("refund_count"), "gmv": F.col("gmv"), "liq": F.col("liquidity_balance"), "late": F.col("fulfillment_on_time_rate") * F.col("transaction_count")}
    beside = {"n": F.least(F.row_number().over(W.entity_order()), F.lit(28)), "std": W.trailing_std(F.col("gmv"), 28), "since": W.days_since_last_positive(F.col("chargeback_count")).cast("double")}
    totals = W.trailing_totals(daily, measures, {n: [7, 28, 60] for n in measures}, beside)
    levels = totals.withColumns({"level": F.col("gmv_28") / F.col("n"), "rate_7": ratio_floored(F.col("refunds_7"), F.col("txn_7")), "rate_28": ratio_floored(F.col("refunds_28"), F.col("txn_28"))})
    want = levels.select(
        "merchant_id",
        "day_index",
        F.col("rate_7").alias("refund_rate_7d"),
        ratio_floored(F.col("late_60"), F.col("txn_60")).alias("fulfillment_on_time_rate_60d"),
        (F.col("liq_28") / F.col("n")).alias("liquidity_balance_28d"),
        ratio_floored(F.col("std"), F.col("level")).alias("gmv_coefficient_of_variation_28d"),
        F.col("since").alias("days_since_last_chargeback"),
        W.deviation_z(F.col("rate_7"), W.expanding_mean(F.col("rate_28")), W.expanding_std(F.col("rate_28"))).alias("refund_rate_deviation_z"),
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.merchant_id, r.day_index): r for r in build_features(daily, signups).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = want.collect()
    assert len(rows) == len(got) == 241
    for r in rows:
        for c in want.columns[2:]:
            assert (r[c] is None) == (got[r.merchant_id, r.day_index][c] is None), (c, r)
            if r[c] is not None:
                assert got[r.merchant_id, r.day_index][c] == pytest.approx(r[c], abs=1e-9), (c, r)
    assert got["m2", 2].liquidity_balance_28d is None and got["m3", 5].merchant_tenure_days is None
    assert got["m5", 0].merchant_tenure_days is None and got["m1", 0].merchant_tenure_days is not None


def test_dates_and_empty_panel(spark):
    daily, signups = ragged(spark)
    want = daily.select("merchant_id", "day_index", (F.weekday("date") >= 5).cast("double").alias("w"), F.dayofyear("date").alias("d"))
    got = build_features(daily, signups).join(want, ["merchant_id", "day_index"]).select("is_weekend", "w", "day_of_year_sin", F.sin(2 * 3.141592653589793 * F.col("d") / 365.25).alias("s"))
    assert all(r.is_weekend == r.w and r.day_of_year_sin == pytest.approx(r.s) for r in got.collect())
    none = build_features(daily.limit(0), signups)
    assert none.columns[3:] == feature_columns() and none.count() == 0


def test_wide_rounding_compiles_to_methods_the_jit_takes(spark):
    daily, signups = ragged(spark)
    whole = rounded(build_features(daily, signups))._jdf.queryExecution().debug().codegenToSeq()
    sizes = [whole.apply(k)._3().maxMethodCodeSize() for k in range(whole.size())]
    assert max(sizes, default=0) <= 8000


def test_wide_rounding_rounds_all_alike(spark):
    values = [0.1234565, -0.1234565, None, float("nan"), float("inf"), 1e12, -0.0]
    df = spark.createDataFrame([tuple([v] * 30) for v in values], ", ".join(f"c{k} double" for k in range(30)))
    narrow = [str(r[0]) for r in rounded(df.select("c0")).collect()]
    for r, n in zip(rounded(df).collect(), narrow):
        assert {str(v) for v in r} == {n}
