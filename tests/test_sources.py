import json

from pyspark.sql import functions as F

from tests.helpers import day, panel
from tidepanel.operators.features import build_features, feature_columns
from tidepanel.sources import tables
from tidepanel.sources.schemas import MERCHANTS
from tidepanel.sources.storage import shared_folder, written


def _dataset(spark, root):
    daily = panel(spark, [dict()] * 5)
    daily.coalesce(1).write.csv(f"{root}/raw/daily_observations.csv", header=True)
    merchant = {f.name: 1.0 if f.dataType.simpleString() == "double" else 1 if f.dataType.simpleString() == "bigint" else "M1" for f in MERCHANTS}
    merchant["signup_date"] = day(-9)
    spark.createDataFrame([tuple(merchant.values())], MERCHANTS).write.csv(f"{root}/raw/merchants.csv", header=True)
    return daily


def test_csv_round_trip_with_declared_schema(spark, tmp_path):
    daily = _dataset(spark, tmp_path)
    got, merchants = tables.load_inputs(spark, str(tmp_path))
    assert got.schema == daily.schema and got.exceptAll(daily).isEmpty() and got.count() == 5
    assert merchants.columns == ["merchant_id", "signup_date"]
    assert "baseline" not in merchants._jdf.queryExecution().executedPlan().toString()


def test_features_and_manifest_are_written_and_read_back(spark, tmp_path):
    _dataset(spark, tmp_path)
    features = build_features(*tables.load_inputs(spark, str(tmp_path)))
    tables.write_features(features, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/processed/features").count() == 5
    rows = tables.read_manifest(spark, f"{tmp_path}/metadata/feature_manifest").orderBy("position").collect()
    assert [r["name"] for r in rows] == feature_columns() and rows[0]["source_columns"][-1] == "gmv"
    doc = json.loads(spark.read.text(f"{tmp_path}/metadata/feature_manifest").first()[0])
    assert doc["n_rows"] == 5 and doc["n_features"] == 55 and doc["groups"]["temporal_velocity"] == 14


def test_result_sink_writes_null_for_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "i int, x double")
    tables.write_results(df, f"{tmp_path}/r")
    assert [r["x"] for r in spark.read.schema("i int, x double").json(f"{tmp_path}/r").orderBy("i").collect()] == [None, None, 0.5]


def test_intermediate_tables_live_in_the_shared_folder(spark):
    df = written(spark.range(3).withColumn("d", F.lit("1.50").cast("decimal(18,2)")), "t")
    assert df.count() == 3 and df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_folder(spark).split(":", 1)[-1].lstrip("/"))
