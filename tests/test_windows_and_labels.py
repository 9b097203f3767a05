import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import column, day, panel
from tidepanel.operators import windows as W
from tidepanel.operators.features import build_features, feature_columns, manifest
from tidepanel.operators.labels import build_labels
from tidepanel.plans.inputs import Dataset

SF = "/root/testdata/sf0.001"


def _signups(spark, ids=("M1",)):
    return spark.createDataFrame([(m, day(-100)) for m in ids], "merchant_id string, signup_date date")


def test_trailing_rate_is_volume_weighted(spark):
    df = panel(spark, [dict(chargeback_count=n, transaction_count=t) for n, t in ((1, 10), (0, 0), (2, 10), (0, 5))])
    got = df.withColumn("r", W.trailing_rate(F.col("chargeback_count"), F.col("transaction_count"), 2))
    assert column(got, "r") == pytest.approx([0.1, 0.1, 0.2, 2 / 15])


def test_zero_denominator_without_floor_is_null(spark):
    df = panel(spark, [dict(transaction_count=0), dict(transaction_count=0, chargeback_count=1)])
    got = df.withColumn("r", W.trailing_rate_unfloored(F.col("chargeback_count"), F.col("transaction_count"), 7))
    assert column(got, "r") == [None, None]


def test_trailing_std_of_one_row_is_zero(spark):
    df = panel(spark, [dict(gmv=float(v)) for v in (2, 4, 4)])
    assert column(df.withColumn("s", W.trailing_std(F.col("gmv"), 2)), "s") == pytest.approx([0, 2**0.5, 0])


def test_days_since_last_positive_is_capped(spark):
    df = panel(spark, [dict(chargeback_count=n) for n in (0, 3, 0, 0, 1)])
    assert column(df.withColumn("d", W.days_since_last_positive(F.col("chargeback_count"))), "d") == [90, 0, 1, 2, 0]


def test_running_total_path_equals_direct_frames(spark):
    rng = random.Random(3)
    df = panel(spark, [dict(transaction_count=rng.randint(0, 9), gmv=rng.randint(0, 99999) / 100) for _ in range(100)])
    exact = df.withColumn("money", F.col("gmv").cast("decimal(18,2)"))
    got = W.trailing_totals(exact, {"t": F.col("transaction_count"), "m": F.col("money"), "f": F.col("gmv")}, {"t": [7, 60], "m": [28], "f": [28]})
    want = got.withColumns(
        {
            "t7": W.trailing_sum(F.col("transaction_count"), 7),
            "t60": W.trailing_sum(F.col("transaction_count"), 60),
            "m28": W.trailing_sum(F.col("gmv"), 28),
        }
    )
    for r in want.collect():
        assert r["t_7"] == r["t7"] and r["t_60"] == r["t60"]
        assert r["m_28"] == pytest.approx(r["m28"]) and r["f_28"] == pytest.approx(r["m28"])


def test_feature_matrix_shape_and_first_row(spark):
    features = build_features(panel(spark, [dict()] * 3), _signups(spark))
    assert features.columns == ["merchant_id", "date", "day_index", *feature_columns()]
    assert len(feature_columns()) == 55 and len({r["name"] for r in manifest()}) == 55
    first = features.where("day_index = 0").first()
    assert first["chargeback_rate_deviation_z"] == 0 and first["merchant_tenure_days"] == 100
    assert first["payment_mix_hhi_7d"] == pytest.approx(0.2)


def test_double_and_decimal_money_agree(spark):
    rng = random.Random(5)
    rows = [dict(gmv=rng.randint(100, 99999) / 100, liquidity_balance=rng.randint(100, 99999) / 100, chargeback_count=rng.randint(0, 2)) for _ in range(70)]
    doubles = panel(spark, rows)
    money = ["gmv", "refund_amount", "chargeback_amount", "liquidity_balance", "pending_settlement_amount"]
    decimals = doubles.withColumns({c: F.col(c).cast("decimal(18,2)") for c in money})
    a = build_features(doubles, _signups(spark)).orderBy("day_index").toPandas()
    b = build_features(decimals, _signups(spark)).orderBy("day_index").toPandas()
    for c in feature_columns():
        assert a[c].tolist() == pytest.approx(b[c].tolist(), abs=1e-4), c


def test_feature_ranges_and_truncation_invariance(spark):
    d = Dataset(spark, SF).store("daily")
    full = build_features(d.daily, d.dimension).where("day_index < 60").toPandas()
    prefix = build_features(d.daily.where("day_index < 60"), d.dimension).toPandas()
    key = ["merchant_id", "day_index"]
    full, prefix = (x.sort_values(key).reset_index(drop=True) for x in (full, prefix))
    assert full.equals(prefix[full.columns])
    for c in feature_columns():
        if c.endswith("_z"):
            assert full[c].between(-10, 10).all()
        if c.startswith(("refund_rate_", "chargeback_rate_")) and c.endswith("d"):
            assert full[c].between(0, 1).all()
    assert full["days_since_last_chargeback"].between(0, 90).all()


def test_labels_by_hand(spark):
    amounts = [10, 0, 0, 0, 0, 0, 0, 100, 0]
    df = panel(spark, [dict(chargeback_amount=float(a)) for a in amounts])
    rows = {r["day_index"]: r for r in build_labels(df, [7]).collect()}
    assert sorted(rows) == [0, 1]
    assert rows[0]["elevation_ratio_amount"] == pytest.approx(100 / 70) and rows[0]["label_elevated_chargeback"] == 0
    assert rows[1]["elevation_ratio_amount"] == pytest.approx(100 / 35) and rows[1]["label_elevated_chargeback"] == 1
    assert rows[1]["baseline_daily_chargeback_amount_trailing"] == 5


def test_label_of_a_short_history_has_no_rows(spark):
    assert build_labels(panel(spark, [dict()] * 5), [7]).count() == 0
