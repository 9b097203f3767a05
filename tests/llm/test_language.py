import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.samples import awkward, empty
from tidepanel.llm import language

SYLLABLES = {"aa": "ka lo mi tu re sa".split(), "bb": "sch ung ein ach ver lich".split(), "cc": "ñó ció ent ado os llé".split()}


def sentence(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def frame(spark, seed, n):
    draw = random.Random(seed)
    langs = [draw.choice(list(SYLLABLES)) for _ in range(n)]
    return spark.createDataFrame(
        [(k, sentence(draw, lang, draw.randrange(3, 60)), lang) for k, lang in enumerate(langs)], "doc_id long, text string, lang string"
    )


def test_held_out_accuracy_and_rejection(spark):
    data = frame(spark, 1, 400)
    held = language.fold() == 1
    model = language.fit(data, ~held)
    assert model.languages == sorted(SYLLABLES)
    got = language.identify(data.where(held), model).join(data, "doc_id").collect()
    assert len(got) > 80
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    assert sum(r.accepted for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert not model.predict("Ξεσκεπάζω την ψυχοφθόρα βδελυγμία")[2]  # nothing like it was learned
    again = language.fit(data.repartition(7), ~held)
    assert np.array_equal(model.scores, again.scores)


def test_buckets_equal_a_plain_count():
    for words in ("Straße naïve ÉTÉ x", "a", "ab  12 cde-fgh", "ñandú " * 5):
        codes = language.code_points(words)
        want = []
        for n in language.NGRAMS:
            for i in range(len(codes) - n + 1):
                gram = [int(c) for c in codes[i : i + n]]
                if 32 in gram[1:-1]:
                    continue
                rolling = gram[0]
                for c in gram[1:]:
                    rolling = (rolling * 0x01000193 + c) % 2**32
                want.append((rolling ^ (n * 0x9E3779B1) % 2**32) * 0x85EBCA6B % 2**32 >> 32 - 15)
        assert sorted(language.buckets(codes, 15)) == sorted(want)


def test_sample_is_bounded_and_loses_no_language(spark):
    many = [(k, f"word{k} " * 5, f"l{k % 230:03d}") for k in range(920)]
    hot = [(1000 + k, "the same text in a third of all rows", "l000") for k in range(500)]
    long = [(5000, "ab " * 100_000, "zz")]
    data = spark.createDataFrame(many + hot + long, "doc_id long, text string, lang string")
    rows = language.sampled(data, F.lit(True)).collect()
    assert len({r.lang for r in rows}) == 231  # a rare language learns like any other
    assert sum(r.text.startswith("the same") for r in rows) == 1
    assert max(len(r.text) for r in rows) == language.MAX_CHARACTERS
    few = language.sampled(data, F.lit(True), 2).groupBy("lang").count().collect()
    assert sum(r["count"] for r in few) < 700


def test_labels_and_ids_are_no_inputs(spark):
    data = frame(spark, 2, 150)
    model = language.fit(data, F.lit(True))
    other = data.withColumn("lang", F.lit("aa")).withColumn("doc_id", F.col("doc_id") + 1000)
    a = sorted((r.lang_pred, r.score) for r in language.identify(data, model).collect())
    assert a == sorted((r.lang_pred, r.score) for r in language.identify(other, model).collect())


def test_awkward_rows(spark):
    model = language.fit(frame(spark, 3, 150), F.lit(True))
    rows = language.identify(awkward(spark), model).collect()
    assert len(rows) == awkward(spark).count()
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in SYLLABLES
    nothing = language.fit(empty(spark), F.lit(True))
    assert nothing.predict("words") == ("und", 0.0, False)
    assert language.identify(empty(spark), model).count() == 0
    assert language.accepted(awkward(spark), model).columns == awkward(spark).columns


def test_buckets_stay_within_words():
    codes = language.code_points("Ab 12 cD")
    assert "".join(map(chr, codes)) == " ab cd "
    grams = {n: len([1 for i in range(len(codes) - n + 1) if 32 not in codes[i + 1 : i + n - 1]]) for n in language.NGRAMS}
    assert len(language.buckets(codes, 15)) == sum(grams.values())
    assert len(language.code_points("12 34")) == 0
