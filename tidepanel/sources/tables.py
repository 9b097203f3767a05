"""Readers and sinks for stored datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.features import MANIFEST_SCHEMA, feature_columns, manifest_df
from tidepanel.sources.schemas import PANEL_KEYS, TABLES

# Where each table lies below a dataset directory.
LOCATIONS = {
    "merchants": "raw/merchants.csv",
    "daily_observations": "raw/daily_observations.csv",
    "events": "scenarios/events.csv",
    "labels": "processed/labels.csv",
}


def read_table(spark: SparkSession, data_dir: str, table: str) -> DataFrame:
    """CSV scan with the declared schema; nothing is inferred, and the header must agree."""
    return spark.read.schema(TABLES[table]).csv(
        f"{data_dir}/{LOCATIONS[table]}", header=True, dateFormat="yyyy-MM-dd", enforceSchema=False
    )


def load_inputs(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """(daily, merchants) with merchants cut to id and signup date, so no ground truth can flow on."""
    return (
        read_table(spark, data_dir, "daily_observations"),
        read_table(spark, data_dir, "merchants").select("merchant_id", "signup_date"),
    )


def write_features(features: DataFrame, data_dir: str, fmt: str = "parquet") -> None:
    """The feature matrix plus its manifest with row count and group sizes."""
    spark = features.sparkSession
    columns = [c for c in features.columns if c not in PANEL_KEYS]
    path = f"{data_dir}/processed/features"
    writer = features.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)
    stored = spark.read.schema(features.schema).format(fmt).options(header=True).load(path)
    rows = stored.agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    entries = manifest_df(spark)
    groups = entries.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    # Both lists have one entry per feature or group.
    document = entries.agg(
        F.count(F.lit(1)).alias("n_features"),
        rows.alias("n_rows"),
        F.lit(columns).alias("feature_columns"),
        groups.agg(F.map_from_entries(F.collect_list(F.struct("group", "n")))).scalar().alias("groups"),
        F.collect_list(F.struct(*MANIFEST_SCHEMA.fieldNames())).alias("features"),
    )
    document.coalesce(1).write.mode("overwrite").json(f"{data_dir}/metadata/feature_manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Feature metadata rows, in file order, from a manifest document."""
    schema = T.StructType(
        [
            T.StructField("feature_columns", T.ArrayType(T.StringType())),
            T.StructField("features", T.ArrayType(MANIFEST_SCHEMA)),
        ]
    )
    document = spark.read.schema(schema).json(path, multiLine=True)
    return document.select(F.posexplode("features").alias("position", "feature")).select("position", "feature.*")


def null_for_nan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities become null, as JSON and CSV have no spelling for them."""
    chosen = columns or [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns(
        {c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c)) for c in chosen}
    )


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Result sink: nested rows as JSON, flat ones as CSV."""
    writer = null_for_nan(df).write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)
