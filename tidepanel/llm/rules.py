"""Quality rules: a decision list learned by sequential covering, as a Spark conditional expression.

Statistics of the whole texts are array expressions within a row.  For learning, the statistics of
the labelled documents are cut at quantiles and counted by their bins; growing and pruning a rule
needs only small aggregates of these counts.  Each rule is a conjunction of thresholds that marks
low quality.  It grows on two thirds of the labelled documents by information gain and is then cut
back to the prefix that does best on the other third.  What a rule covers leaves the training rows
before the next one grows.  All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import SPACES, given_id, identified
from tidepanel.sources.storage import written

# Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3

#: Low-quality documents that a rule must cover to count.
LEAST_COVERED = 3

_UPPER, _DIGITS, _CALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?"
FEATURES = (
    "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "call_share", "words_per_line"
)


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """(id, carry..., counts...) for every row of ``docs`` (doc_id, text); a null text counts as empty.

    n_repeat_words are the words covered by any three-word window whose words occur as a window
    twice or more in the text.  Windows are sorted within the row, so the cost of a long text is
    n log n.
    """
    rows = identified(docs, "text", *carry).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select(
        "id",
        *carry,
        "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
    )
    last = F.size("words") - WINDOW
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.concat_ws(" ", *[F.get("words", i + k) for k in range(WINDOW)]).alias("w"), i.alias("i")),
    )
    rows = rows.select(
        "id",
        *carry,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _count_of(F.col("text"), _UPPER).alias("n_upper"),
        _count_of(F.col("text"), _DIGITS).alias("n_digits"),
        _count_of(F.col("text"), _CALLS).alias("n_calls"),
        F.when(last >= 1, F.sort_array(windows)).alias("windows"),
    )
    again = F.transform(
        "windows",
        lambda x, k: F.when((x["w"] == F.get("windows", k - 1)["w"]) | (x["w"] == F.get("windows", k + 1)["w"]), x["i"]),
    )
    rows = rows.withColumn("again", F.sort_array(F.filter(again, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows", "again")


def features() -> dict[str, Column]:
    """Ratios of the counts that rules may test; zero where there is nothing to divide by."""

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "mean_word": ratio("word_chars", "n_words"),
        "symbol_share": ratio("n_symbols", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "upper_share": ratio("n_upper", "word_chars"),
        "digit_share": ratio("n_digits", "word_chars"),
        "call_share": ratio("n_calls", "word_chars"),
        "words_per_line": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each marking low quality; what none of them marks is kept."""

    rules: tuple[tuple[Test, ...], ...]

    def verdict(self) -> Column:
        """True for kept rows, as one ordered conditional expression over the statistics."""
        out = None
        for rule in self.rules:
            holds = _all([test.column() for test in rule])
            out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def rule_number(self) -> Column:
        """Which rule decides, from 1; null where none does."""
        out = None
        for number, rule in enumerate(self.rules, 1):
            holds = _all([test.column() for test in rule])
            out = F.when(holds, F.lit(number)) if out is None else out.when(holds, F.lit(number))
        return F.lit(None).cast("int") if out is None else out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Training rows as bins: (bins, pruning, bad, n).  Bin b of a feature is b cuts below the value."""
    columns = features()

    def cuts_below(feature: str) -> Column:
        value = columns[feature]
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[feature]]), lambda c: c < value))

    bins = F.array(*[cuts_below(f) if cuts[f] else F.lit(0) for f in FEATURES])
    pruning = F.pmod(F.xxhash64("id", F.lit("prune")), F.lit(3)) == 0
    return rows.groupBy(bins.alias("bins"), pruning.alias("pruning"), "bad").agg(F.count(F.lit(1)).alias("n"))


def _holds(test: tuple[int, bool, int]) -> Column:
    feature, above, bin_ = test
    value = F.get("bins", F.lit(feature))
    return value > bin_ if above else value <= bin_


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(
    stats: DataFrame,
    labels: DataFrame,
    cuts_per_feature: int = 24,
    max_rules: int = 8,
    max_tests: int = 3,
    least_precision: float = 0.95,
    least_covered: int = LEAST_COVERED,
) -> DecisionList:
    """A decision list from those rows of ``stats`` (see :func:`statistics`) that ``labels`` (doc_id, quality) covers.

    Quality 0 is low; null labels and labels without a document teach nothing; without low-quality
    labels the list is empty and keeps everything.  A rule must reach ``least_precision`` on the
    pruning third and cover at least ``least_covered`` low-quality documents there.
    """
    known = identified(labels, "quality").where(F.col("quality").isNotNull()).groupBy("id").agg(F.min("quality").alias("quality"))
    rows = stats.join(known, "id").withColumn("bad", F.col("quality") == 0)
    rows = written(rows, "labelled")
    steps = [(i + 1) / (cuts_per_feature + 1) for i in range(cuts_per_feature)]
    # Quantiles of each class, so that a rare class gets cuts of its own.
    found = (
        rows.groupBy("bad").agg(*[F.percentile_approx(c, steps, 1000).alias(f) for f, c in features().items()]).collect()
    )
    cuts = {f: sorted({x for r in found for x in (r[f] or [])}) for f in FEATURES}
    counts = written(_counts(rows, cuts), "counts")

    rules: list[list[tuple[int, bool, int]]] = []
    poor: set[tuple[int, bool]] = set()
    left = counts
    while len(rules) < max_rules:
        rule = _grown(left.where("not pruning"), cuts, max_tests, poor)
        if not rule:
            break
        good = _pruned(left.where("pruning"), rule, least_precision, least_covered)
        if good:
            rules.append(good)
            left = left.where(~_all([_holds(t) for t in good]))
        else:
            poor.add(rule[0][:2])  # no later rule starts with this feature and side
    named = [tuple(Test(FEATURES[f], above, cuts[FEATURES[f]][b]) for f, above, b in rule) for rule in rules]
    return DecisionList(tuple(_centred(rows, named)))


def _centred(rows: DataFrame, rules: list[tuple[Test, ...]]) -> list[tuple[Test, ...]]:
    """Limits moved to the middle between the low-quality rows a test holds for and the good ones it does not.

    The outer twentieth of the low-quality rows is left aside, so that a stray one cannot pull a
    limit towards good documents.  One aggregate for all rules.  A low-quality row counts for the
    first rule that covers it; good rows count for every test.
    """
    sides, before = [], F.lit(True)
    for rule in rules:
        covered = before & _all([t.column() for t in rule])
        for test in rule:
            value = features()[test.feature]
            inside = F.when(covered & F.col("bad"), value)
            outside = F.when(~test.column() & ~F.col("bad"), value)
            edge = F.percentile_approx(inside, 0.05 if test.above else 0.95, 1000)
            sides += [edge, F.max(outside) if test.above else F.min(outside)]
        before = before & ~covered
    if not sides:
        return []
    found = iter(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sides)]).first())
    out = []
    for rule in rules:
        tests = []
        for test in rule:
            near, far = next(found), next(found)
            limit = test.limit if near is None or far is None else (near + far) / 2
            tests.append(Test(test.feature, test.above, limit))
        out.append(tuple(tests))
    return out


def _grown(counts: DataFrame, cuts: dict[str, list[float]], max_tests: int, poor: set) -> list[tuple[int, bool, int]]:
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < max_tests:
        table = (
            counts.select(F.posexplode("bins").alias("f", "b"), "bad", "n")
            .groupBy("f", "b")
            .agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q"))
            .collect()
        )
        cells = {(r.f, r.b): (r.p, r.q) for r in table}
        p0, n0 = (sum(cells.get((0, b), (0, 0))[k] for b in range(len(cuts[FEATURES[0]]) + 1)) for k in (0, 1))
        if p0 < LEAST_COVERED or not n0:
            break
        best = (1e-9, None)
        for f, name in enumerate(FEATURES):
            low_p = low_n = 0
            for b in range(len(cuts[name])):
                p, n = cells.get((f, b), (0, 0))
                low_p, low_n = low_p + p, low_n + n
                for above, p, n in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
                    if not rule and (f, above) in poor:
                        continue
                    best = max(best, (_gain(p, n, p0, n0), (f, above, b)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule.append(best[1])
        counts = counts.where(_holds(best[1]))
    return rule


def _pruned(counts: DataFrame, rule: list, least_precision: float, least_covered: int) -> list:
    """The prefix with the best (p - n) / (p + n) on the pruning rows, if it is good enough."""
    sums = []
    for size in range(1, len(rule) + 1):
        holds = _all([_holds(t) for t in rule[:size]])
        sums += [F.sum(F.when(holds & (F.col("bad") == bad), F.col("n")).otherwise(0)) for bad in (True, False)]
    row = counts.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    scored = [((row[2 * i] or 0), (row[2 * i + 1] or 0), i + 1) for i in range(len(rule))]
    scored = [(p, n, size) for p, n, size in scored if p >= least_covered and p / (p + n) >= least_precision]
    return rule[: max(scored, key=lambda x: ((x[0] - x[1]) / (x[0] + x[1]), x[0], -x[2]))[2]] if scored else []


def judged(rows: DataFrame, rules: DecisionList) -> DataFrame:
    """Counts, the base rule's and the list's verdict for every row of statistics.

    A null or empty text has no words and fails the base rule.  Repeated rows are judged each.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rows.select(
        given_id().alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(rules.verdict()).alias("kept"),
        rules.rule_number().alias("rule"),
    )
