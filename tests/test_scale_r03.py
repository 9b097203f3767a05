"""Panels and audits move and read their rows once."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.helpers import panel
from tidepanel.operators import effects, quality
from tidepanel.operators.features import build_features
from tidepanel.operators.labels import build_labels
from tidepanel.sources import panels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Repeated lines, two lines of a customer on a day, a null customer and a null day."""
    root = str(tmp_path_factory.mktemp("tables"))
    d = date
    lines = [
        (1, 1, d(1995, 1, 2), 10.0, 0.0, 1.0, "R", "F"),
        (1, 1, d(1995, 1, 2), 10.0, 0.0, 1.0, "R", "F"),
        (2, 1, d(1995, 1, 5), 20.0, 0.1, 2.0, "A", "O"),
        (3, 1, d(1995, 1, 5), 30.0, 0.0, 3.0, "N", "F"),
        (4, 1, d(1995, 1, 5), 30.0, 0.0, 3.0, "N", "F"),
        (4, 1, d(1995, 1, 5), None, 0.0, 3.0, "N", "F"),
        (5, 2, None, 30.0, 0.0, 3.0, "N", "F"),
        (5, 2, d(1995, 1, 4), 30.0, 0.0, None, "N", "F"),
    ]
    spark.createDataFrame(
        lines, "l_orderkey long, l_suppkey long, l_shipdate date, l_extendedprice double, l_discount double, l_quantity double, l_returnflag string, l_linestatus string"
    ).write.parquet(f"{root}/lineitem.parquet")
    orders = [(1, 7, "1-URGENT"), (2, 7, "2-HIGH"), (3, 8, "1-URGENT"), (4, None, "5-LOW"), (5, 7, "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(1, 3), (2, 3)], "s_suppkey long, s_nationkey int").write.parquet(f"{root}/supplier.parquet")
    return root


def test_cells_by_hand(spark, given):
    rows = {(r.entity, r.day): r for r in panels.entity_days(spark, given, "supplier").collect()}
    first, second = rows[1, date(1995, 1, 2)], rows[1, date(1995, 1, 5)]
    assert (first.lines, first.gmv, first.refunds, first.refund_cents, first.customers, first.new_customers) == (2, 2000, 2, 2000, 1, 1)
    assert (second.lines, second.gmv, second.chargeback_cents, second.customers, second.new_customers) == (4, 7800, 1800, 3, 2)
    assert (second.quantity, second.pay_card, second.pay_bnpl, second.on_time) == (11, 3000, 3000, 3)
    assert rows[2, date(1995, 1, 4)].quantity is None and rows[2, date(1995, 1, 4)].new_customers == 1
    merged = {r.day: r for r in panels.entity_days(spark, given, "nation").collect()}
    assert (merged[date(1995, 1, 4)].customers, merged[date(1995, 1, 4)].new_customers) == (1, 0)


def test_lines_move_once_by_customer(spark, given):
    moved = re.findall(r"Exchange hashpartitioning\(entity#\d+L?, customer#", plan(panels.entity_days(spark, given, "supplier")))
    assert len(moved) == 1


@pytest.mark.parametrize("level", ["nation", "supplier"])
def test_dense_rows_are_not_moved_again(spark, given, level):
    daily = panels.panel(spark, given, level)
    for built in (build_features(daily, panels.merchant_signups(spark, given, level)), build_labels(daily), quality.gap_audit(daily)):
        text = plan(built)
        assert "explode(sequence(" in text
        above = text[: text.index("explode(sequence(")]
        assert not re.search(r"Exchange hashpartitioning\((entity|merchant_id)#", above)


def test_supplier_days_keep_all_tasks(spark, given):
    assert "REPARTITION_BY_NUM" in plan(panels.panel(spark, given, "supplier"))


def test_gap_audit_without_copies_of_rows(spark):
    rows = {
        "whole": [0, 1, 2],
        "hole": [0, 2, 3],
        "late": [1, 2, 3],
        "twice": [0, 1, 1],
    }
    daily = panel(spark, [dict(merchant_id=m, day_index=i) for m, days in rows.items() for i in days])
    daily = daily.unionByName(panel(spark, [dict(merchant_id="null", day_index=i) for i in (0, 1)]).withColumn("date", F.when(F.col("day_index") > 0, F.col("date"))))
    found = quality.gap_audit(daily)
    assert "Expand" not in plan(found)
    got = {r.merchant_id: (r.n_days, r.day_index_gap, r.date_gap) for r in found.collect()}
    assert got == {"whole": (3, False, False), "hole": (3, True, True), "late": (3, True, False), "twice": (3, True, True), "null": (2, False, True)}


def test_core_columns_are_counted_one_by_one(spark, monkeypatch):
    plans, write = {}, quality.written

    def noted(df, name):
        plans[name] = plan(df)
        return write(df, name)

    monkeypatch.setattr(quality, "written", noted)
    daily = panel(spark, [dict(gmv=float(i), refund_rate=float("nan") if i else 0.5, aov=None) for i in range(5)])
    got = {r.metric: r for r in quality.core_distributions(daily).collect()}
    assert all("Expand" not in p for p in plans.values()) and set(got) == set(quality.CORE_COLUMNS)
    assert (got["gmv"]["count"], got["gmv"]["mean"], got["gmv"]["median"], got["gmv"]["max"]) == (5, 2.0, 2.0, 4.0)
    assert (got["refund_rate"]["count"], got["refund_rate"]["median"], got["aov"]["count"], got["aov"]["mean"]) == (1, 0.5, 0, None)


def test_labels_are_read_once_for_their_prevalence(spark, tmp_path):
    rows = [(7, "A", 1), (7, "A", 0), (7, "B", 0), (14, "B", 1)]
    spark.createDataFrame(rows, "horizon_days long, merchant_id string, label_elevated_chargeback long").write.parquet(f"{tmp_path}/labels")
    labels, merchants = spark.read.parquet(f"{tmp_path}/labels"), spark.createDataFrame([("A",), ("B",)], "merchant_id string")
    found = effects.label_prevalence(labels, merchants)
    assert not [f for f in found.inputFiles() if f"{tmp_path}/labels" in f]
    got = {r.horizon_days: r for r in found.collect()}
    assert (got[7].usable_rows, got[7].positives, got[7].median_merchant_rate, got[14].n_merchants_all_positive) == (3, 1, 0.25, 1)
