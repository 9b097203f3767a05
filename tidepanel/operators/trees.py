"""Forests and boosted trees on features binned once.

Training rows become one byte per feature and are written once.  A level of trees needs, per node,
candidate feature and bin, two sums over the node's rows; they are kept as integers (targets and
gradients in fixed point), so a tree does not depend on how rows are dealt or retried.

* While the binned rows stay below a bound, they are broadcast: each task grows whole trees of a forest,
  or all rounds of one boosting model.
* Beyond it, rows stay where they are: one pass per level sums every tree of every model at once, the
  partial sums meet by (model, tree), and only the chosen splits return to the driver.  Boosting keeps
  the margins beside the bins and writes them anew every ``MARGIN_ROUNDS`` rounds.

Both ways give the same trees; tests compare them with each other and with brute force.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.sources.storage import written

#: Binned training rows up to this size are broadcast; larger ones are summed level by level.
MOST_BROADCAST_BYTES = 64 << 20
MARGIN_ROUNDS = 25
FIXED_POINT = float(1 << 20)
ROWS_AT_ONCE = 16_384
QUANTILE_ACCURACY = 10_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

CLASSES, VALUES, BOOSTING = "classes", "values", "boosting"


@dataclass(frozen=True)
class Plan:
    """What to grow.  ``share`` is the part of the rows a boosting round draws; forests draw Poisson weights."""

    kind: str
    trees: int
    depth: int
    bins: int = 64
    least_rows: int = 20
    features: int = 0
    rate: float = 0.05
    share: float = 0.8
    penalty: float = 1.0
    least_weight: float = 1.0
    seed: int = 42

    @property
    def nodes(self) -> int:
        return (1 << (self.depth + 1)) - 1


@dataclass
class Trees:
    """Trees in heap order: node i has children 2i + 1 (bin at most ``cut``) and 2i + 2; leaves have feature -1.

    Node statistics are two integer sums: rows and targets of a forest, curvatures and gradients of boosting.
    """

    feature: np.ndarray
    cut: np.ndarray
    size: np.ndarray
    target: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(count: int, nodes: int) -> "Trees":
        shape = (count, nodes)
        return Trees(np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape))

    def row(self, t: int) -> list[bytes]:
        return [x[t].tobytes() for x in (self.feature, self.cut, self.size, self.target, self.gain)]

    def put(self, t: int, row: Sequence[bytes]) -> None:
        for x, part in zip((self.feature, self.cut, self.size, self.target, self.gain), row):
            x[t] = np.frombuffer(part, x.dtype)

    def split(self, t: int, node: int, feature: int, cut: int, gain: float, whole, left, right) -> None:
        """Record what a node holds and, unless ``feature`` is -1, how it splits."""
        self.size[t, node], self.target[t, node] = whole
        if feature >= 0:
            self.feature[t, node], self.cut[t, node], self.gain[t, node] = feature, cut, gain
            for child, (size, target) in ((2 * node + 1, left), (2 * node + 2, right)):
                self.size[t, child], self.target[t, child] = size, target

    def node_of(self, t: int, bins: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        node = np.zeros(len(bins), np.int64)
        feature, cut, rows = self.feature[t], self.cut[t], np.arange(len(bins))
        while True:
            asked = feature[node]
            inner = asked >= 0
            if not inner.any():
                return node
            right = bins[rows, np.maximum(asked, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)


TREE_SCHEMA = "model long, tree int, feature binary, cut binary, size binary, target binary, gain binary"


# --- draws ---------------------------------------------------------------------------------------


def _uniform(keys: np.ndarray, *seeds: int) -> np.ndarray:
    """A number in [0, 1) per row key that only the key and the seeds decide."""
    x = keys.view(np.uint64).copy()
    for seed in seeds:
        x = (x ^ (np.uint64(seed & 0xFFFFFFFF) + np.uint64(1))) * _MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)]))


def bootstrap(keys: np.ndarray, plan: Plan, model: int, tree: int) -> np.ndarray:
    return np.searchsorted(_POISSON, _uniform(keys, plan.seed, model, tree), side="right")


def candidates(plan: Plan, width: int, model: int, tree: int, nodes: Sequence[int]) -> np.ndarray:
    """Candidate features per node, ascending; boosting draws them once per tree."""
    count = plan.features or width
    if count >= width:
        return np.tile(np.arange(width), (len(nodes), 1))
    of = [0] * len(nodes) if plan.kind == BOOSTING else nodes
    draw = lambda n: np.random.default_rng([plan.seed, model, tree, n]).permutation(width)[:count]
    return np.sort([draw(n) for n in of], axis=1)


# --- one level -----------------------------------------------------------------------------------


def histograms(bins: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, chosen: np.ndarray, n_bins: int) -> np.ndarray:
    """(node, candidate, bin, 2) integer sums of ``a`` and ``b``; ``place`` is the row's node among the level's."""
    nodes, width = chosen.shape
    if (chosen == chosen[0]).all():
        start = place * n_bins
        sums = [[np.bincount(start + bins[:, f], w, nodes * n_bins).reshape(nodes, n_bins) for w in (a, b)] for f in chosen[0]]
        return np.rint(np.array(sums)).astype(np.int64).transpose(2, 0, 3, 1)
    out = np.zeros((2, nodes * width * n_bins))
    offset = np.arange(width) * n_bins
    for s in range(0, len(place), ROWS_AT_ONCE):
        at = place[s : s + ROWS_AT_ONCE]
        found = bins[np.arange(s, s + len(at))[:, None], chosen[at]]
        cell = ((at * (width * n_bins))[:, None] + offset + found).ravel()
        for side, weight in enumerate((a, b)):
            out[side] += np.bincount(cell, np.repeat(weight[s : s + len(at)], width), out.shape[1])
    return np.rint(out).astype(np.int64).reshape(2, nodes, width, n_bins).transpose(1, 2, 3, 0)


def _worth(plan: Plan, a: np.ndarray, b: np.ndarray, root: tuple[int, int]) -> np.ndarray:
    """What a node's purity is worth; a split gains its children's worth less the node's."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if plan.kind == BOOSTING:
            return (b / FIXED_POINT) ** 2 / (a / FIXED_POINT + plan.penalty)
        if plan.kind == VALUES:
            return np.where(a > 0, (b / FIXED_POINT) ** 2 / a, 0.0)
        up, down = class_weights(root)
        positive, negative = up * b, down * (a - b)
        return np.where(a > 0, (positive**2 + negative**2) / (positive + negative), 0.0)


def class_weights(root: tuple[int, int]) -> tuple[float, float]:
    """Balanced within a tree's own bootstrap sample."""
    rows, positive = root
    return rows / (2 * max(positive, 1)), rows / (2 * max(rows - positive, 1))


def best_splits(plan: Plan, root: tuple[int, int], nodes: Sequence[int], chosen: np.ndarray, sums: np.ndarray) -> list[tuple]:
    """Per node (node, feature, cut, gain, sums of node, left and right) of the most gaining split; feature -1 without one.

    The lowest feature and bin win ties.
    """
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)
    right = total[:, None, None, :] - left
    least = plan.least_weight * FIXED_POINT if plan.kind == BOOSTING else plan.least_rows
    allowed = np.minimum(left[..., 0], right[..., 0]) >= least
    worth = lambda s: _worth(plan, s[..., 0], s[..., 1], root)
    gain = worth(left) + worth(right) - worth(total)[:, None, None]
    flat = np.where(allowed, gain, -np.inf).reshape(len(nodes), -1)
    best = flat.argmax(axis=1)
    out = []
    for i, (node, at) in enumerate(zip(nodes, best.tolist())):
        slot, cut = divmod(at, sums.shape[2])
        good = flat[i, at] > 1e-9
        parts = [tuple(map(int, x)) for x in (total[i], left[i, slot, cut], right[i, slot, cut])]
        out.append((int(node), int(chosen[i, slot]) if good else -1, cut, float(flat[i, at]) if good else 0.0, *parts))
    return out


def _open(trees: Trees, t: int, level: int) -> np.ndarray:
    """The nodes of a level that the splits so far reach."""
    nodes = np.arange((1 << level) - 1, (2 << level) - 1)
    return nodes if level == 0 else nodes[trees.feature[t, (nodes - 1) // 2] >= 0]


def level_sums(plan: Plan, trees: Trees, t: int, level: int, model: int, number: int, bins, a, b) -> tuple | None:
    """Nodes, candidates and sums of one level of tree ``t``, the ``number``-th of its model, over the given rows."""
    nodes = _open(trees, t, level)
    if not len(nodes):
        return None
    place = np.full(plan.nodes, -1)
    place[nodes] = np.arange(len(nodes))
    here = place[trees.node_of(t, bins)]
    rows = here >= 0
    chosen = candidates(plan, bins.shape[1], model, number, nodes.tolist())
    return nodes, chosen, histograms(bins[rows], here[rows], a[rows], b[rows], chosen, plan.bins)


def drawn_rows(plan: Plan, model: int, number: int, keys, y, margin=None, weight: float = 1.0) -> tuple:
    """Rows drawn for a tree with their two sums: rows and targets, or curvature and gradient of the weighted log loss."""
    if plan.kind != BOOSTING:
        times = bootstrap(keys, plan, model, number)
        drawn = np.flatnonzero(times)
        return drawn, times[drawn].astype(float), times[drawn] * y[drawn].astype(float)
    drawn = np.flatnonzero(_uniform(keys, plan.seed, model, number, 7) < plan.share)
    p = 1 / (1 + np.exp(-margin[drawn]))
    w = np.where(y[drawn] > 0, weight, 1.0) * FIXED_POINT
    return drawn, np.rint(np.maximum(p * (1 - p), 1e-16) * w), np.rint((p - y[drawn]) * w)


def node_values(plan: Plan, trees: Trees, t: int) -> np.ndarray:
    """Per node: the share of the weighted positives, the mean target, or the boosting step."""
    size, target = trees.size[t], trees.target[t]
    if plan.kind == BOOSTING:
        return -plan.rate * (target / FIXED_POINT) / (size / FIXED_POINT + plan.penalty)
    if plan.kind == VALUES:
        return target / FIXED_POINT / np.maximum(size, 1)
    up, down = class_weights((int(size[0]), int(target[0])))
    return up * target / np.maximum(up * target + down * (size - target), 1e-300)


def node_weights(plan: Plan, trees: Trees, t: int) -> np.ndarray:
    """Per node: the weight of the training rows it holds."""
    size, target = trees.size[t], trees.target[t]
    if plan.kind != CLASSES:
        return size.astype(float)
    up, down = class_weights((int(size[0]), int(target[0])))
    return up * target + down * (size - target)


def grow(plan: Plan, trees: Trees, t: int, model: int, number: int, bins, keys, y, margin=None, weight: float = 1.0) -> None:
    """One tree from rows that are all here."""
    drawn, a, b = drawn_rows(plan, model, number, keys, y, margin, weight)
    mine = bins[drawn]
    for level in range(plan.depth):
        found = level_sums(plan, trees, t, level, model, number, mine, a, b)
        if found is None:
            return
        nodes, chosen, sums = found
        root = tuple(map(int, sums[0, 0].sum(axis=0))) if level == 0 else (int(trees.size[t, 0]), int(trees.target[t, 0]))
        for split in best_splits(plan, root, nodes.tolist(), chosen, sums):
            trees.split(t, *split)


# --- binned rows -----------------------------------------------------------------------------------


def bin_edges(frame: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Distinct cut points per column at approximate quantiles of all rows, one aggregate over the frame."""
    marks = [i / bins for i in range(1, bins)]
    found = frame.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), marks, QUANTILE_ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array([v for v in found[i] or [] if not np.isnan(v)], float)) for i in range(len(columns))]


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Per value the number of cuts below it; NaN counts as largest."""
    out = np.empty(values.shape, np.uint8)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(cuts, values[:, j], side="left")
    return out


def binned(frame: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str], edges: list[np.ndarray], scale: float) -> DataFrame:
    """(model, key, bins, y): a byte per feature, the target in fixed point, a key that draws hang on."""
    names = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = to_bins(batch[names].to_numpy(float), edges)
            y = np.rint(batch["_y"].to_numpy(float) * scale).astype(np.int64)
            yield pd.DataFrame({"model": batch["_model"], "key": batch["_key"], "bins": [c.tobytes() for c in codes], "y": y})

    source = frame.select(
        F.col("_model"), F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("_key"), F.col(target).cast("double").alias("_y"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in names],
    )
    return source.mapInPandas(run, "model long, key long, bins binary, y long")


def _arrays(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, width)
    return bins, rows["key"].to_numpy(np.int64), rows["y"].to_numpy(np.int64)


# --- small: rows broadcast, trees dealt -------------------------------------------------------------


def _grow_broadcast(rows: DataFrame, plan: Plan, width: int, weights: dict[int, float]) -> dict[int, Trees]:
    spark = rows.sparkSession
    held = {int(m): _arrays(part, width) for m, part in rows.toArrow().to_pandas().groupby("model")}
    shared = spark.sparkContext.broadcast(held)
    jobs = [(m, t) for m in held for t in range(1 if plan.kind == BOOSTING else plan.trees)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, tree in zip(batch["model"].tolist(), batch["tree"].tolist()):
                bins, keys, y = shared.value[model]
                if plan.kind != BOOSTING:
                    trees = Trees.empty(1, plan.nodes)
                    grow(plan, trees, 0, model, tree, bins, keys, y)
                    yield pd.DataFrame([(model, tree, *trees.row(0))], columns=NAMES)
                    continue
                trees, margin = Trees.empty(plan.trees, plan.nodes), np.zeros(len(y))
                for t in range(plan.trees):
                    grow(plan, trees, t, model, t, bins, keys, y, margin, weights[model])
                    margin += node_values(plan, trees, t)[trees.node_of(t, bins)]
                yield pd.DataFrame([(model, t, *trees.row(t)) for t in range(plan.trees)], columns=NAMES)

    slots = max(1, min(len(jobs), 4 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame(jobs, "model long, tree int").repartition(slots, "model", "tree")
    out = {m: Trees.empty(plan.trees, plan.nodes) for m in held}
    for r in dealt.mapInPandas(run, TREE_SCHEMA).collect():
        out[r["model"]].put(r["tree"], r[2:])
    shared.unpersist()
    return out


# --- large: rows stay, sums travel ------------------------------------------------------------------


SUMS = "model long, tree int, node int, cells binary, a binary, b binary"
SPLITS = "model long, tree int, node int, feature int, cut int, gain double, whole array<long>, lower array<long>, upper array<long>"


def _pass(rows: DataFrame, plan: Plan, width: int, state: dict[int, Trees], level: int, numbers: Sequence[int], since: int, weights) -> None:
    """Split one level of the given trees of every model; margins in ``rows`` hold the trees before ``since``."""
    shared = rows.sparkSession.sparkContext.broadcast(state)
    boosting = plan.kind == BOOSTING

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        here = pd.concat(parts) if parts else None
        for model, part in here.groupby("model") if here is not None else ():
            model = int(model)
            trees, (bins, keys, y) = shared.value[model], _arrays(part, width)
            margin = part["margin"].to_numpy(float).copy() if boosting else None
            if boosting:
                for t in range(since, numbers[0]):
                    margin += node_values(plan, trees, t)[trees.node_of(t, bins)]
            for t in numbers:
                drawn, a, b = drawn_rows(plan, model, t, keys, y, margin, weights.get(model, 1.0))
                found = level_sums(plan, trees, t, level, model, t, bins[drawn], a, b)
                if found is None:
                    continue
                nodes, _, cells = found
                flat = cells.reshape(len(nodes), -1, 2)
                filled = [np.flatnonzero(f.any(axis=1)).astype(np.int32) for f in flat]
                yield pd.DataFrame(
                    [(model, t, n, at.tobytes(), f[at, 0].tobytes(), f[at, 1].tobytes()) for n, f, at in zip(nodes.tolist(), flat, filled)],
                    columns=["model", "tree", "node", "cells", "a", "b"],
                )

    def best(group: pd.DataFrame) -> pd.DataFrame:
        model, tree, node = (int(group[c].iloc[0]) for c in ("model", "tree", "node"))
        trees = shared.value[model]
        chosen = candidates(plan, width, model, tree, [node])
        total = np.zeros((chosen.shape[1] * plan.bins, 2), np.int64)
        for cells, a, b in zip(group["cells"], group["a"], group["b"]):
            at = np.frombuffer(cells, np.int32)
            total[at, 0] += np.frombuffer(a, np.int64)
            total[at, 1] += np.frombuffer(b, np.int64)
        cells = total.reshape(1, chosen.shape[1], plan.bins, 2)
        root = tuple(map(int, cells[0, 0].sum(axis=0))) if node == 0 else (int(trees.size[tree, 0]), int(trees.target[tree, 0]))
        (split,) = best_splits(plan, root, [node], chosen, cells)
        return pd.DataFrame([(model, tree, *split[:4], *map(list, split[4:]))], columns=["model", "tree", "node", "feature", "cut", "gain", "whole", "lower", "upper"])

    found = rows.mapInPandas(sums, SUMS).groupBy("model", "tree", "node").applyInPandas(best, SPLITS).collect()
    shared.unpersist()
    for r in found:
        state[r["model"]].split(r["tree"], *r[2:])


def _with_margins(rows: DataFrame, plan: Plan, width: int, state: dict[int, Trees], since: int, upto: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            margin = batch["margin"].to_numpy(float).copy()
            for model in batch["model"].unique().tolist():
                mine = (batch["model"] == model).to_numpy()
                bins = _arrays(batch[mine], width)[0]
                for t in range(since, upto):
                    margin[mine] += node_values(plan, shared.value[model], t)[shared.value[model].node_of(t, bins)]
            yield batch.assign(margin=margin)

    return written(rows.mapInPandas(run, rows.schema), "margins")


def _grow_by_level(rows: DataFrame, plan: Plan, width: int, weights: dict[int, float]) -> dict[int, Trees]:
    state = {m: Trees.empty(plan.trees, plan.nodes) for m in weights}
    if plan.kind != BOOSTING:
        for level in range(plan.depth):
            _pass(rows, plan, width, state, level, range(plan.trees), 0, weights)
        return state
    rows, since = written(rows.withColumn("margin", F.lit(0.0)), "margins"), 0
    for t in range(plan.trees):
        if t - since == MARGIN_ROUNDS:
            rows, since = _with_margins(rows, plan, width, state, since, t), t
        for level in range(plan.depth):
            _pass(rows, plan, width, state, level, [t], since, weights)
    return state


# --- models ----------------------------------------------------------------------------------------


@dataclass
class TreeModel:
    plan: Plan
    columns: list[str]
    edges: list[np.ndarray]
    trees: Trees

    @property
    def scale(self) -> float:
        return 1.0 if self.plan.kind == BOOSTING else 1.0 / self.plan.trees

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in range(self.plan.trees):
            out += node_values(self.plan, self.trees, t)[self.trees.node_of(t, bins)]
        return out * self.scale

    def scored(self, values: np.ndarray) -> np.ndarray:
        """The probability of a class model, the mean target of the others."""
        raw = self.raw(to_bins(values, self.edges))
        return 1 / (1 + np.exp(-raw)) if self.plan.kind == BOOSTING else raw

    def score(self, frame: DataFrame, name: str) -> DataFrame:
        """Add the score; only the model's own columns pass through Python, as Arrow batches."""
        shared = frame.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(shared.value.scored(np.column_stack([c.to_numpy(float) for c in columns])))

        return frame.withColumn(name, scored(*[F.col(f"`{c}`").cast("double") for c in self.columns]))

    def importances(self) -> np.ndarray:
        """Gain by feature: shares within each tree, averaged, for forests; mean gain per split for boosting."""
        per_tree = np.zeros((self.plan.trees, len(self.columns)))
        splits = np.zeros(len(self.columns))
        for t in range(self.plan.trees):
            inner = self.trees.feature[t] >= 0
            np.add.at(per_tree[t], self.trees.feature[t][inner], self.trees.gain[t][inner])
            splits += np.bincount(self.trees.feature[t][inner], minlength=len(self.columns))
        if self.plan.kind == BOOSTING:
            mean = per_tree.sum(axis=0) / np.maximum(splits, 1)
        else:
            mean = (per_tree / np.maximum(per_tree.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
        return mean / max(mean.sum(), 1e-300)

    def table(self, spark: SparkSession) -> DataFrame:
        """A row per tree, as saved and as the attribution job reads it; its size is fixed by the plan."""
        return spark.createDataFrame([(0, t, *self.trees.row(t)) for t in range(self.plan.trees)], TREE_SCHEMA)


NAMES = ["model", "tree", "feature", "cut", "size", "target", "gain"]


@dataclass
class Binned:
    """Training rows of one or more models as bytes, written once; any number of fits start from them."""

    rows: DataFrame
    columns: list[str]
    edges: list[np.ndarray]
    counts: dict[int, tuple[int, int]]

    @property
    def size(self) -> int:
        return sum(n for n, _ in self.counts.values()) * (len(self.columns) + 32)


def prepare(frame: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str], model: str | None = None, bins: int = 64, scale: float = 1.0) -> Binned:
    """Bin the rows of one model per value of the integer column ``model`` (0 without one).

    ``keys`` name a row; draws hang on them, so repeated keys are drawn alike.  A null feature counts as NaN,
    which sorts last; rows without a target are left out.
    """
    keyed = frame.where(F.col(target).isNotNull()).withColumn("_model", F.col(model).cast("long") if model else F.lit(0).cast("long"))
    edges = bin_edges(keyed, columns, bins)
    rows = written(binned(keyed, columns, target, keys, edges, scale), "binned")
    counts = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()
    return Binned(rows, list(columns), edges, {int(r["model"]): (r["n"], r["p"]) for r in counts})


def fit(data: Binned, plan: Plan, most_bytes: int = MOST_BROADCAST_BYTES) -> dict[int, TreeModel]:
    """A model per key of the binned rows, all grown together."""
    weights = {m: (n - p) / max(p, 1) if plan.kind == BOOSTING else 1.0 for m, (n, p) in data.counts.items()}
    way = _grow_broadcast if data.size <= most_bytes else _grow_by_level
    grown = way(data.rows, plan, len(data.columns), weights)
    return {m: TreeModel(plan, data.columns, data.edges, t) for m, t in grown.items()}
