import random
import re

from pyspark.sql import functions as F

from tests.llm.samples import awkward, docs, empty, text
from tidepanel.llm import rules


def slow(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    places = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + d for v in places.values() if len(v) > 1 for k in v for d in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_brute_force(spark):
    draw = random.Random(1)
    pieces = ["a", "b", "c d", "e|f", "é x", "🙂", "\n", " ", "\t", "a b c\n", "a b c", "\x0b", "#", "\x1c"]
    rows = [(k, " ".join(draw.choice(pieces) for _ in range(draw.randrange(60)))) for k in range(300)]
    got = rules.judged(rules.statistics(docs(spark, rows).union(awkward(spark))), rules.DecisionList(())).collect()
    want = sorted((str(i), *slow(t)) for i, t in rows + [(r.doc_id, r.text) for r in awkward(spark).collect()])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r.doc_id), *[r[n] for n in names]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def labelled(spark, seed, n=400):
    draw = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        t = text(1000 * seed + k, 90)
        low = draw.random() < 0.2
        if low and draw.random() < 0.5:
            t = " ".join(w + "###" for w in t.split())
        elif low:
            t = t.upper().replace(" ", "!! ")
        rows.append((k, t))
        labels.append((k, 0 if low else 1))
    return docs(spark, rows), labels


def test_learned_list_separates_held_out_rows(spark):
    data, labels = labelled(spark, 1)
    schema = "doc_id long, quality int"
    made = rules.learn(rules.statistics(data), spark.createDataFrame(labels + [(None, 0), (99999, 0), (1, None)], schema))
    assert 1 <= len(made.rules) <= 8
    fresh, truth = labelled(spark, 2)
    truth = dict(truth)
    got = rules.judged(rules.statistics(fresh), made).collect()
    assert sum(r.kept == bool(truth[r.doc_id]) for r in got if not r.base_failed) >= 0.98 * sum(not r.base_failed for r in got)
    assert all((r.rule is None) == r.kept for r in got if not r.base_failed)
    plan = rules.judged(rules.statistics(fresh), made)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_nothing_to_learn(spark):
    data, labels = labelled(spark, 3, 60)
    schema = "doc_id long, quality int"
    assert rules.learn(rules.statistics(data), spark.createDataFrame([(i, 1) for i, _ in labels], schema)).rules == ()
    assert rules.learn(rules.statistics(data), spark.createDataFrame([], schema)).rules == ()
    assert rules.learn(rules.statistics(empty(spark)), spark.createDataFrame(labels, schema)).rules == ()
    assert rules.judged(rules.statistics(empty(spark)), rules.DecisionList(())).count() == 0


def test_first_rule_that_holds_decides(spark):
    made = rules.DecisionList(((rules.Test("symbol_share", True, 0.5),), (rules.Test("mean_word", True, 2.0), rules.Test("upper_share", False, 0.1))))
    rows = spark.createDataFrame([(10, 20, 9, 0, 0, 1, 0, 0, 0), (10, 40, 0, 0, 0, 1, 0, 0, 0), (10, 10, 0, 0, 0, 1, 0, 0, 0)],
                                 "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_calls long")
    got = rows.select(made.verdict().alias("kept"), made.rule_number().alias("rule")).orderBy(F.col("rule").asc_nulls_last()).collect()
    assert [tuple(r) for r in got] == [(False, 1), (False, 2), (True, None)]
