"""Additive attribution of forest scores (path-dependent Shapley values).

A leaf reached through splits on d distinct features is a small game: with feature j known,
the row either stays on the leaf's path or not; with j unknown, it stays with the share of
training weight that took that branch.  Its Shapley values depend on the row only through
the d yes/no answers, so they are tabulated per answer pattern when the model is prepared: a task
per tree fills the tables of its leaves, all patterns at once.  Scoring a batch finds the answers of
all leaves of a tree by interval tests on bins and adds up table entries by feature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.lookups import with_metadata
from tidepanel.operators.trees import CLASSES, TreeModel, Trees, node_values, node_weights, to_bins

FAITHFULNESS_TOLERANCE = 1e-4
TOP_K = 6
#: The tables of all leaves are broadcast; 300 trees of depth 6 take at most 59 MB.
MOST_TABLE_BYTES = 256 << 20
ROWS_AT_ONCE = 1024


@dataclass
class TreeTable:
    """Leaves by path feature: bins above ``low`` and up to ``high`` stay on the path; ``values`` by (leaf, slot, pattern).

    ``order`` lists the (leaf, slot) pairs by feature and ``starts`` where each of ``features`` begins in it.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    values: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    features: np.ndarray


@dataclass
class Explainer:
    columns: list[str]
    edges: list[np.ndarray]
    base_value: float
    trees: list[TreeTable]


def shapley_tables(value: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(leaf, slot, pattern) for leaves of ``d`` slots; slot i of a pattern is on the path where bit i is set.

    The average over coalition sizes is the integral over x of the product of s(1 - x) + a x over the
    other slots, a polynomial of degree d - 1, which Gauss-Legendre nodes integrate exactly.
    """
    d = shares.shape[1]
    answers = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    nodes, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
    out = np.zeros((len(value), d, 1 << d))
    for x, w in zip((nodes + 1) / 2, weights / 2):
        factor = shares[:, :, None] * (1 - x) + answers.T[None] * x
        for j in range(d):
            out[:, j] += w * np.delete(factor, j, axis=1).prod(axis=1)
    return out * value[:, None, None] * (answers.T[None] - shares[:, :, None])


def _paths(feature: np.ndarray, cut: np.ndarray, weight: np.ndarray) -> list[tuple[int, dict[int, list]]]:
    """Every leaf with [low, high, share] per feature on its path."""
    out, held = [], [(0, {})]
    while held:
        node, bounds = held.pop()
        f = int(feature[node])
        if f < 0:
            out.append((node, bounds))
            continue
        for child, is_left in ((2 * node + 1, True), (2 * node + 2, False)):
            low, high, share = bounds.get(f, [-1, 255, 1.0])
            at = int(cut[node])
            low, high = (low, min(high, at)) if is_left else (max(low, at), high)
            held.append((child, {**bounds, f: [low, high, share * weight[child] / weight[node]]}))
    return out


def tree_table(model: TreeModel, t: int) -> tuple[float, TreeTable]:
    """Expected value and leaf tables of one tree; leaves with fewer features repeat over the unused bits."""
    value, weight = node_values(model.plan, model.trees, t) * model.scale, node_weights(model.plan, model.trees, t)
    paths = _paths(model.trees.feature[t], model.trees.cut[t], weight)
    base = sum(value[n] * weight[n] for n, _ in paths) / weight[0]
    paths = [p for p in paths if p[1]]
    width = max((len(b) for _, b in paths), default=0)
    shape = len(paths), width
    feature, low, high = np.full(shape, -1, np.int16), np.full(shape, -1, np.int16), np.full(shape, 255, np.int16)
    values = np.zeros((*shape, 1 << width))
    for d in range(1, width + 1):
        same = [i for i, (_, b) in enumerate(paths) if len(b) == d]
        if not same:
            continue
        found = np.array([[[f, *b[f]] for f in sorted(b)] for b in (paths[i][1] for i in same)])
        feature[same, :d], low[same, :d], high[same, :d] = found[:, :, 0], found[:, :, 1], found[:, :, 2]
        table = shapley_tables(value[[paths[i][0] for i in same]], found[:, :, 3])
        values[same, :d] = np.tile(table, 1 << (width - d))
    flat = feature.ravel()
    order = np.argsort(flat, kind="stable")[int((flat < 0).sum()) :]
    features, starts = np.unique(flat[order], return_index=True)
    return float(base), TreeTable(np.maximum(feature, 0), low, high, values, order, starts, features)


def build_explainer(model: TreeModel, columns: Sequence[str], spark: SparkSession) -> Explainer:
    """Tables of all leaves, a task per group of trees; refused beyond the size that may be broadcast."""
    if model.plan.kind != CLASSES or list(columns) != model.columns:
        raise ValueError("attribution explains a class forest over its own columns")
    plan, edges = model.plan, model.edges
    most = plan.trees * (1 << plan.depth) * plan.depth * (8 << plan.depth)
    if most > MOST_TABLE_BYTES:
        raise ValueError(f"leaf tables may take {most} bytes, more than {MOST_TABLE_BYTES}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            one = TreeModel(plan, list(columns), edges, Trees.empty(plan.trees, plan.nodes))
            for row in batch.itertuples(index=False):
                one.trees.put(0, row[2:])
                base, table = tree_table(one, 0)
                parts = [x.tobytes() for x in vars(table).values()]
                yield pd.DataFrame([(row.tree, base, table.feature.shape[1], parts)], columns=["tree", "base", "width", "parts"])

    dealt = model.table(spark).repartition(max(1, min(plan.trees, 4 * spark.sparkContext.defaultParallelism)), "tree")
    found = sorted(dealt.mapInPandas(run, "tree int, base double, width int, parts array<binary>").collect(), key=lambda r: r["tree"])
    return Explainer(list(columns), edges, sum(r["base"] for r in found), [_unpacked(r["width"], r["parts"]) for r in found])


def _unpacked(width: int, parts: list[bytes]) -> TreeTable:
    kinds = (np.int16, np.int16, np.int16, np.float64, np.int64, np.int64, np.int16)
    feature, low, high, values, order, starts, features = (np.frombuffer(p, k) for p, k in zip(parts, kinds))
    shape = (-1, width) if width else (0, 0)
    return TreeTable(*(x.reshape(shape) for x in (feature, low, high)), values.reshape(*feature.reshape(shape).shape, -1 if width else 1), order, starts, features)


def contributions(bins: np.ndarray, trees: Sequence[TreeTable]) -> np.ndarray:
    """(row, feature) contributions of binned rows, a chunk of rows and a tree at a time."""
    phi = np.zeros(bins.shape)
    for s in range(0, len(bins), ROWS_AT_ONCE):
        part = bins[s : s + ROWS_AT_ONCE]
        for t in trees:
            if not len(t.order):
                continue
            width = t.feature.shape[1]
            found = part[:, t.feature]
            pattern = ((found > t.low) & (found <= t.high)) @ (1 << np.arange(width))
            cell = t.order * (1 << width) + pattern[:, t.order // width]
            phi[s : s + len(part), t.features] += np.add.reduceat(t.values.ravel()[cell], t.starts, axis=1)
    return phi


def attribute(frame: DataFrame, explainer: Explainer, keep: Sequence[str]) -> DataFrame:
    """(keep, base_value, contributions array<double> in column order, reconstructed)."""
    shared = frame.sparkSession.sparkContext.broadcast(explainer)
    keep = list(keep)

    def explain_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = shared.value
        for batch in batches:
            phi = contributions(to_bins(batch[e.columns].to_numpy(dtype=float), e.edges), e.trees)
            out = batch[keep].copy()
            out["base_value"] = e.base_value
            out["contributions"] = list(phi)
            out["reconstructed"] = e.base_value + phi.sum(axis=1)
            yield out

    source = frame.select(*keep, *[c for c in explainer.columns if c not in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema)
    return source.mapInPandas(
        explain_batches, f"{fields}, base_value double, contributions array<double>, reconstructed double"
    )


def faithfulness(attributed: DataFrame, raw_probability: str = "probability_raw") -> DataFrame:
    """One row: the largest reconstruction error and whether it is within tolerance."""
    error = F.max(F.abs(F.col("reconstructed") - F.col(raw_probability)))
    return attributed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        error.alias("max_abs_reconstruction_error"),
        F.coalesce(error <= FAITHFULNESS_TOLERANCE, F.lit(True)).alias("faithful"),
    )


def assert_faithful(attributed: DataFrame, raw_probability: str = "probability_raw") -> None:
    row = faithfulness(attributed, raw_probability).first()
    if not row["faithful"]:
        raise ValueError(f"attribution misses the score by {row['max_abs_reconstruction_error']:.2e}")


def drivers(attributed: DataFrame, columns: Sequence[str], top_k: int = TOP_K) -> DataFrame:
    """Contributors as structs: all by magnitude, the top positive and the top negative ones."""
    pairs = F.zip_with(
        F.array(*[F.lit(c) for c in columns]),
        "contributions",
        lambda feature, phi: F.struct(
            feature.alias("feature"),
            phi.alias("phi"),
            F.when(phi > 0, "increases_risk").when(phi < 0, "decreases_risk").otherwise("neutral").alias("direction"),
        ),
    )

    def by(key):
        return lambda a, b: (
            F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).when(a["feature"] < b["feature"], -1).otherwise(1)
        )

    return attributed.withColumn("_all", pairs).select(
        *[c for c in attributed.columns if c != "contributions"],
        F.array_sort("_all", by(lambda s: -F.abs(s["phi"]))).alias("all_contributors"),
        F.slice(F.array_sort(F.filter("_all", lambda s: s["phi"] > 0), by(lambda s: -s["phi"])), 1, top_k).alias("top_positive"),
        F.slice(F.array_sort(F.filter("_all", lambda s: s["phi"] < 0), by(lambda s: s["phi"])), 1, top_k).alias("top_negative"),
    )


def described(explained: DataFrame, columns: Sequence[str], manifest: Sequence[dict]) -> DataFrame:
    """Give every listed driver the row's own feature value and what the manifest says of the feature.

    ``explained`` still holds the feature columns; a feature that the manifest lacks has null metadata.
    """
    known = {row["name"]: row for row in manifest}
    said = {name: [known.get(c, {}).get(name) for c in columns] for name in ("group", "definition", "window", "kind")}
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    texts = {name: F.array(*[F.lit(v).cast("string") for v in vs]) for name, vs in said.items()}

    def full(driver):
        at = place[driver["feature"]]
        return F.struct(
            driver["feature"].alias("feature"), F.get(values, at).alias("value"), driver["phi"].alias("phi"), driver["direction"].alias("direction"),
            *[F.get(t, at).alias(name) for name, t in texts.items()],
        )

    lists = ("all_contributors", "top_positive", "top_negative")
    return explained.withColumns({name: F.transform(name, full) for name in lists})


def contributions_long(attributed: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return attributed.select(
        *keys, F.posexplode("contributions").alias("_i", "phi")
    ).select(*keys, F.get(F.array(*[F.lit(c) for c in columns]), F.col("_i")).alias("feature"), "phi")


def global_importance(attributed: DataFrame, columns: Sequence[str], manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature ranking, group ranking) by mean absolute contribution."""
    from pyspark.sql import Window

    # One aggregate per column over the array: a row per feature, whatever the data size.
    stats = attributed.agg(
        *[F.avg(F.abs(F.col("contributions")[i])).alias(f"{c}:abs") for i, c in enumerate(columns)],
        *[F.avg(F.col("contributions")[i]).alias(f"{c}:signed") for i, c in enumerate(columns)],
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"`{c}:abs`").alias("mean_abs_phi"),
                        F.col(f"`{c}:signed`").alias("mean_signed_phi"),
                    )
                    for c in columns
                ]
            )
        ).alias("s")
    ).select("s.*")
    known = with_metadata(stats, manifest).select("feature", "group", "mean_abs_phi", "mean_signed_phi")
    everything = Window.partitionBy(F.lit(0))
    ranking = known.withColumn("rank", F.row_number().over(everything.orderBy(F.desc("mean_abs_phi"), "feature")))
    groups = known.groupBy("group").agg(F.sum("mean_abs_phi").alias("summed_mean_abs_phi"))
    return ranking, groups.withColumn("rank", F.row_number().over(everything.orderBy(F.desc("summed_mean_abs_phi"), "group")))


def elevating_groups(attributed: DataFrame, columns: Sequence[str], groups: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """(keys, groups): feature groups with any positive contribution, for recommendation priority."""
    tagged = F.zip_with(
        F.array(*[F.lit(groups.get(c, "unknown")) for c in columns]), "contributions", lambda g, phi: F.when(phi > 0, g)
    )
    return attributed.select(*keys, F.array_distinct(F.array_compact(tagged)).alias("groups"))


def representative_rows(scored: DataFrame, threshold: float, label: str, keys: Sequence[str]) -> DataFrame:
    """Best true positive, best false positive and the row closest to the threshold."""
    p = F.col("probability")
    who = F.struct(*keys, "probability")
    tie = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    positive, flagged = F.col(label) == 1, p >= threshold
    picks = scored.agg(
        F.max_by(F.when(positive, who), F.when(positive, F.struct(p, tie))).alias("highest_confidence_true_positive"),
        F.max_by(F.when(~positive & flagged, who), F.when(~positive & flagged, F.struct(p, tie))).alias("highest_confidence_false_positive"),
        F.min_by(who, F.struct(F.abs(p - threshold), tie)).alias("borderline_case"),
    )
    names = picks.columns
    return picks.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("example"), F.col(n).alias("row")) for n in names])).alias("e")
    ).select("e.example", "e.row.*").where(F.col("probability").isNotNull())
