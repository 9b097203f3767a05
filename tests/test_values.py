"""Values that rounding, folding and cutting into cells must not change."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import ordered, text
from tidepanel.functions.numeric import fixed
from tidepanel.sources.storage import require_local


def test_rounding_leaves_special_and_large_values(spark):
    values = [None, math.nan, math.inf, -math.inf, 2.5e13, -2.5e13, 1e300, -0.0, 1.0000005, -1.25, 0.1 + 0.2]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(fixed(F.col("v"))).collect()]
    assert got[0] is None and math.isnan(got[1])
    assert got[2:7] == [math.inf, -math.inf, 2.5e13, -2.5e13, 1e300]
    assert [str(v) for v in got[7:]] == ["0.0", "1.000001", "-1.25", "0.3"]


def test_every_injection_pattern_is_found_in_any_case(spark):
    from tidepanel.plans.decision_queries import PLANTED

    hits = len(text.injection_patterns())
    folded = [p.replace("i", "ı") for p in PLANTED[:hits]] + [p.replace("I", "İ") for p in PLANTED[:hits]]
    folded += [p.replace("s", "ſ") for p in PLANTED[:hits]] + [p.upper().replace("K", "K") for p in PLANTED[:hits]]
    rows = [(p, True) for p in PLANTED[:hits] + folded] + [(p, False) for p in PLANTED[hits:]] + [(None, None)]
    got = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", text.contains_injection(F.col("t"))).collect()
    # The default platform name holds neither s nor k nor i, so folding concerns the patterns alone.
    assert [(r.t, r.got) for r in got if r.got != r.want] == []


def test_platform_names_are_taken_literally(spark):
    df = spark.createDataFrame([("you have access to a.b (c)",), ("you have access to axb (c)",), ("YOU HAVE ACCESS TO A.B (C)",)], "t string")
    assert [r[0] for r in df.select(text.contains_injection(F.col("t"), "a.b (c)")).collect()] == [True, False, True]
    accents = spark.createDataFrame([("you have access to É",), ("you have access to é",)], "t string")
    assert [r[0] for r in accents.select(text.contains_injection(F.col("t"), "é")).collect()] == [True, True]


@pytest.mark.parametrize("low, high", [(0.5, 0.501), (-1e9, 1e9)])
def test_cells_are_even_for_any_distribution(spark, low, high):
    n = 1_000_000
    values = spark.range(n).select((F.lit(low) + (high - low) * F.col("id") / n).alias("value"), F.lit(1).alias("n"))
    cuts = ordered.cell_cuts(values, [], "value").first()["_cuts"]
    cell = ordered.order_cell(F.col("value"), F.array(*[F.lit(c) for c in cuts]))
    sizes = [r["count"] for r in values.groupBy(cell.alias("c")).count().collect()]
    assert len(sizes) > 200 and max(sizes) < n / 100


def test_quantiles_do_not_depend_on_the_distribution(spark):
    draw = np.random.default_rng(1)
    data = {"narrow": draw.uniform(0.5, 0.501, 3000), "ties": draw.integers(0, 3, 3000).astype(float), "wide": draw.standard_cauchy(3000), "one": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows + [("narrow", None), ("narrow", math.nan)], "k string, v double")
    probabilities = {"low": 0.01, "mid": 0.5, "high": 0.999}
    got = {r.k: r for r in ordered.exact_quantiles(df, ["k"], "v", probabilities).collect()}
    for k, vs in data.items():
        for name, p in probabilities.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)
    whole = ordered.exact_quantiles(df, [], "v", probabilities).first()
    assert whole["mid"] == pytest.approx(np.quantile(np.concatenate(list(data.values())), 0.5), rel=1e-12)


def test_other_masters_need_a_shared_folder():
    for master in ("local", "local[8]", "local[*]"):
        require_local(master)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            require_local(master)
