import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.ordered import exact_quantiles
from tidepanel.operators import effects, episodes, metrics, quality, splits

L = "label_elevated_chargeback"


def scored(spark, pairs, key="k"):
    return spark.createDataFrame([(key, float(s) if s is not None else None, int(y)) for s, y in pairs], f"g string, score double, {L} int")


def rank(spark, pairs):
    return metrics.ranking_metrics(metrics.score_table(scored(spark, pairs), ["g"], "score"), ["g"]).first()


def test_rank_metrics_with_ties(spark):
    r = rank(spark, [(1, 0), (2, 0), (2, 1), (3, 1)])
    assert r["roc_auc"] == 0.875 and r["pr_auc"] == pytest.approx(5 / 6)
    assert r["best_f1_threshold"] == 2 and r["best_f1"] == pytest.approx(0.8)


def test_auc_is_null_for_one_class(spark):
    assert rank(spark, [(1, 0), (2, 0)])["roc_auc"] is None


def test_auc_matches_all_pairs_on_wide_ranges(spark):
    rng = random.Random(1)
    pairs = [(rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), 0.0, -3.0, 1e-9]), rng.random() < 0.4) for _ in range(400)]
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert rank(spark, pairs)["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, -5.0, rng.gauss(0, 100), rng.random()]) for _ in range(501)]
    probs = {f"q{i}": p for i, p in enumerate((0, 0.1, 0.25, 0.5, 0.77, 0.99, 1))}
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("c", None)], "g string, v double")
    rows = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(rows) == {"a", "b"}
    for n, p in probs.items():
        assert rows["a"][n] == pytest.approx(np.percentile(values, 100 * p)) and rows["b"][n] == 7.0


def test_threshold_metrics_and_cost(spark):
    counts = spark.createDataFrame([(587, 132, 108, 133), (5, 2, 0, 0)], "tn long, fp long, fn long, tp long")
    rows = metrics.false_positive_cost(counts).collect()
    assert [r["net_value_units"] for r in rows[:3]] == [134, 533, 1198]
    assert rows[0]["false_positives_per_true_positive"] == pytest.approx(132 / 133)
    assert math.isinf(rows[3]["false_positives_per_true_positive"])
    assert metrics.threshold_metrics(counts).where("tp = 0").first()["precision"] == 0


def test_grid_threshold_takes_the_first_of_equal_scores(spark):
    r = metrics.grid_threshold(scored(spark, [(5.1, 1), (5.2, 1), (-9, 0)]), ["g"], "score").first()
    assert r["threshold"] == -3.0 and r["train_f1"] == 1.0 and r["signal_min"] == -9


def test_reliability_bins_are_left_open(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    edges = np.percentile(p, np.linspace(0, 100, 11))[1:-1]
    bins = np.searchsorted(edges, p)
    got = {r["bin"]: r for r in metrics.reliability_curve(scored(spark, zip(p, y)), ["g"], "score").collect()}
    assert set(got) == set(bins)
    for b in got:
        assert got[b]["n"] == (bins == b).sum() and got[b]["mean_predicted"] == pytest.approx(p[bins == b].mean())


LEAD_CASES = [
    # name, days, labels on, predicted on, horizon, expected status, lead, offset
    ("one run", 20, range(5, 15), range(20), 7, "early", 5, None),
    ("sustained", 20, range(10, 15), range(6, 10), 7, "early", 4, None),
    ("isolated blip", 20, range(10, 15), [1], 7, "missed", None, None),
    ("late", 20, range(10, 15), [12, 13], 7, "detected_at_or_after_onset", None, 2),
    ("clipped", 30, range(20, 25), range(30), 7, "early", 7, None),
    ("first day", 10, range(0, 3), range(10), 7, "detected_at_or_after_onset", None, 0),
]


def test_lead_time_cases(spark):
    rows = [
        (name, i, int(i in set(on)), i in set(pred))
        for name, n, on, pred, *_ in LEAD_CASES
        for i in range(n)
    ]
    frame = spark.createDataFrame(rows, f"merchant_id string, day_index long, {L} int, predicted boolean")
    found = episodes.warning_lead_times(frame, 7)
    got = {r["merchant_id"]: r for r in found.collect()}
    for name, *_, status, lead, offset in LEAD_CASES:
        assert (got[name]["status"], got[name]["lead_time_days"], got[name]["offset_days"]) == (status, lead, offset), name
    summary = episodes.lead_time_summary(found).first()
    assert (summary["n_early_warning"], summary["n_missed"], summary["median_warning_lead_time_days"]) == (3, 1, 5)


def test_label_runs_join_over_missing_days_but_alerts_do_not(spark):
    rows = [("m", i, 1, True) for i in (0, 1, 5)] + [("m", 7, 0, True), ("m", 9, 1, False)]
    frame = spark.createDataFrame(rows, f"merchant_id string, day_index long, {L} int, predicted boolean")
    got = episodes.warning_lead_times(frame, 7).orderBy("onset_day").collect()
    assert [(r["onset_day"], r["end_day"]) for r in got] == [(0, 5), (9, 9)]
    assert got[1]["status"] == "missed"


@pytest.mark.parametrize("n,want", [(7, (4, 2, 1)), (6, (4, 1, 1)), (1, (1, 0, 0)), (10, (6, 2, 2))])
def test_largest_remainder(spark, n, want):
    got = spark.range(1).select(*[c.alias(k) for k, c in splits.apportion(F.lit(n), splits.SPLIT_FRACTIONS).items()]).first()
    assert tuple(got) == want


def test_entity_split_is_whole_stratified_and_deterministic(spark):
    sizes = [7, 7, 6, 6, 6, 6, 6, 6]
    rows = [(f"M{s}-{i}", f"A{s}") for s, n in enumerate(sizes) for i in range(n)]
    entities = spark.createDataFrame(rows, "merchant_id string, archetype string")
    split = splits.entity_split(entities)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 32, "val": 10, "test": 8}
    assert tuple(splits.split_coverage(split, entities).first()) == (0, 0, 0)
    again = splits.entity_split(entities.orderBy(F.desc("merchant_id")).repartition(5))
    assert split.exceptAll(again).isEmpty()
    assert not splits.entity_split(entities, seed=7).exceptAll(split).isEmpty()


def test_calibration_halves_are_stratified_and_disjoint(spark):
    rows = [(f"m{i}", i, int(i % 3 == 0)) for i in range(60)]
    val = spark.createDataFrame(rows, f"merchant_id string, day_index long, {L} int")
    halves = splits.calibration_halves(val, L, ["merchant_id", "day_index"])
    counts = {(r[L], r["half"]): r["count"] for r in halves.groupBy(L, "half").count().collect()}
    assert counts == {(0, "calibration"): 20, (0, "threshold"): 20, (1, "calibration"): 10, (1, "threshold"): 10}


def test_horizon_sets(spark):
    sets = {7: "ab", 14: "bc", 30: ""}
    rows = [(m, "2024-01-01", h, int(m in s)) for h, s in sets.items() for m in "abcd"]
    labels = spark.createDataFrame(rows, f"merchant_id string, as_of_date string, horizon_days long, {L} int")
    r = effects.horizon_agreement(effects.horizon_pivot(labels)).first()
    assert r["jaccard_h7_h14"] == pytest.approx(1 / 3) and r["p_h14_given_h7"] == 0.5
    assert r["p_h7_given_h30"] is None and r["fraction_all_agree"] == 0.25


def test_robust_summary_drops_text_and_keeps_empty_groups(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", "3"), ("b", "y")], "g string, v string")
    rows = {r["g"]: r for r in quality.robust_summary(df, ["g"], "v").collect()}
    assert rows["a"]["count"] == 2 and rows["a"]["median"] == 2 and rows["b"]["count"] == 0 and rows["b"]["median"] is None


def test_single_feature_audit_flags_a_perfect_feature(spark):
    rows = [(f, float(v), int(y)) for y in (0, 1) for i in range(20) for f, v in (("leak", y), ("noise", i))]
    df = spark.createDataFrame(rows, f"feature string, value double, {L} int")
    got = {r["feature"]: r for r in metrics.single_feature_audit(df, []).collect()}
    assert got["leak"]["suspicious"] and got["leak"]["rank"] == 1 and not got["noise"]["suspicious"]


def test_importance_concentration(spark):
    df = spark.createDataFrame([("m", "a", 0.6), ("m", "b", 0.4), ("z", "a", 0.0)], "model string, feature string, importance double")
    rows = {r["model"]: r for r in metrics.importance_concentration(df).collect()}
    assert rows["m"]["dominant"] and rows["m"]["top_feature"] == "a" and not rows["z"]["dominant"]
