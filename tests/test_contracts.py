"""Join contracts, row-set overlaps, content digests, staged runs and the append-only log."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import decisions, frames, quality
from tidepanel.operators.features import feature_columns
from tidepanel.plans.staged import StagedRun, input_files

LABELS = "merchant_id string, as_of_date date, day_index long, horizon_days long, label_elevated_chargeback long, future_chargeback_amount double, baseline_daily_chargeback_amount_trailing double"


@pytest.fixture()
def parts(spark):
    labels = spark.createDataFrame([(m, None, d, h, 0, 1.0, 1.0) for m in "AB" for d in range(3) for h in (7, 14)], LABELS)
    features = spark.createDataFrame([(m, d, 0.5) for m in "AB" for d in range(3)], "merchant_id string, day_index long, gmv_level_28d double")
    dimension = spark.createDataFrame([("A", "x", "t"), ("B", "y", "t")], "merchant_id string, archetype string, business_tier string")
    split = spark.createDataFrame([("A", "train"), ("B", "test")], "merchant_id string, split string")
    return labels, features, dimension, split


def test_frames_hold_their_contracts(parts):
    labels, features, dimension, split = parts
    columns = ["gmv_level_28d"]
    frame = frames.horizon_frame(labels, features, dimension, columns)
    assert frame.count() == 12 and set(columns) < set(feature_columns())
    assert frames.with_roles(frame, split, 2).where("frame_role is null").count() == 2  # late rows of a training entity
    for broken in (
        frames.horizon_frame(labels.unionAll(labels.limit(1)), features, dimension, columns),
        frames.horizon_frame(labels, features.unionAll(features.limit(1)), dimension, columns),
        frames.horizon_frame(labels, features, dimension.unionAll(dimension.limit(1)), columns),
        frames.with_roles(frame, split.where("merchant_id = 'A'"), 2),
        frames.with_roles(frame, split.unionAll(split), 2),
    ):
        with pytest.raises(Exception, match="more than one row|no split for entity"):
            broken.agg(F.count("frame_role" if "frame_role" in broken.columns else "archetype")).collect()


def test_the_check_adds_no_exchange(parts):
    _, features, _, _ = parts
    days = ["merchant_id", "day_index"]
    left = features.withColumnRenamed("gmv_level_28d", "v").hint("merge")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(left.join(frames.once_per_key(features, days, "f"), days)) == exchanges(left.join(features, days))


def test_row_overlaps_are_multisets_with_nulls(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b long")
    sets = {
        "left": make([("x", 1), ("x", 1), (None, 2), ("", None), ("only", 1)]),
        "right": make([("x", 1), ("x", 1), ("x", 1), (None, 2), ("", None)]),
        "other": make([("z", 9)]),
        "none": make([]),
    }
    got = {(r.left_set, r.right_set): r.n_shared for r in frames.row_overlaps(sets, ["a", "b"]).collect()}
    assert got == {("left", "right"): 4, ("left", "other"): 0, ("left", "none"): 0, ("right", "other"): 0, ("right", "none"): 0, ("other", "none"): 0}


def test_digests_ignore_order_and_follow_changes(spark, tmp_path):
    one, two = (spark.range(40).select("id", (F.col("id") / 7).alias("v"), F.when(F.col("id") > 5, F.lit("s")).alias("t")).where(w) for w in ("id < 15", "id >= 15"))
    folder = f"{tmp_path}/t"
    one.coalesce(1).write.parquet(f"{folder}/part=1")
    two.coalesce(1).write.parquet(f"{folder}/part=2")
    read = lambda paths: spark.read.option("basePath", folder).parquet(*paths).select("id", "v", "t")
    listing = input_files(spark, folder)
    whole = quality.merged_digests(quality.file_digests(read([folder]), "t")).first()
    assert whole == quality.merged_digests(quality.file_digests(read([folder]).orderBy(F.desc("id")).coalesce(1), "t")).first()
    known = quality.updated_digests(spark.createDataFrame([], "path string, length long, modificationTime timestamp, table_name string, file string, n_rows long, digest_high long, digest_low long"), listing, read, "t").cache()
    assert known.count() == 2 and quality.merged_digests(known).first() == whole
    asked = []
    more = lambda paths: asked.extend(paths) or read(paths)
    spark.range(100, 103).select("id", F.lit(0.5).alias("v"), F.lit("n").alias("t")).coalesce(1).write.parquet(f"{folder}/part=3")
    grown = quality.updated_digests(known, input_files(spark, folder), more, "t")
    assert quality.merged_digests(grown).first() == quality.merged_digests(quality.file_digests(read([folder]), "t")).first()
    assert len(asked) == 1 and "part=3" in asked[0]
    shutil.rmtree(f"{folder}/part=3")
    asked.clear()
    assert quality.merged_digests(quality.updated_digests(known, input_files(spark, folder), more, "t")).first() == whole and not asked


def test_a_rerun_takes_complete_stages(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.range(3).coalesce(1).write.parquet(f"{folder}/a.parquet")
    made = []
    stage = lambda run: run.stage("numbers", lambda: made.append(1) or spark.range(5)).count()
    assert stage(StagedRun(spark, folder, "s")) == stage(StagedRun(spark, folder, "s")) == 5 and len(made) == 1
    assert stage(StagedRun(spark, folder, "other")) == 5 and len(made) == 2

    def fails():
        raise RuntimeError("lost")

    run = StagedRun(spark, folder, "s")
    with pytest.raises(RuntimeError):
        run.stage("later", fails)
    assert not run.complete("later") and run.stage("later", lambda: spark.range(2)).count() == 2
    spark.range(1).coalesce(1).write.parquet(f"{folder}/b.parquet")
    assert StagedRun(spark, folder, "s").root != run.root


def test_log_takes_a_batch_and_a_request_once(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "request_id string, merchant_id string, date string")
    path = f"{tmp_path}/log"
    first = make([("r1", "A", "2024-01-01"), ("r2", "B", "2024-01-02"), ("r2", "B", "2024-01-02")])
    assert decisions.append_actions(first, path, "b1") == 2
    assert decisions.append_actions(first, path, "b1") == 0
    assert decisions.append_actions(make([("r2", "B", "2024-01-09"), ("r3", "A", "2024-01-03")]), path, "b2") == 1
    assert sorted((r.request_id, r.batch) for r in decisions.read_actions(spark, path).collect()) == [("r1", "b1"), ("r2", "b1"), ("r3", "b2")]
    assert [r.request_id for r in decisions.read_actions(spark, path, "A").collect()] == ["r3", "r1"]
    assert decisions.append_actions(first.limit(0), path, "b3") == 0
    with pytest.raises(ValueError):
        decisions.append_actions(first, path, "../b")
