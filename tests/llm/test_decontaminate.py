import random

from tests.llm.samples import WORDS, awkward, docs, empty
from tidepanel.llm import decontaminate as d


def slow(item, text):
    """Smallest edit distance of item to any passage of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def passage(draw, n):
    return [draw.choice(WORDS) + draw.choice(["", "s", "ed", "ing"]) for _ in range(n)]


def damaged(draw, item, edits):
    item = list(item)
    for _ in range(edits):
        at = draw.randrange(len(item))
        item[at : at + 1] = draw.choice([[], ["zz"], [item[at], "yy"]])
    return item


def test_myers_equals_the_table():
    draw = random.Random(1)
    for _ in range(400):
        item, text = [[draw.choice("abcd") for _ in range(draw.randrange(1, n))] for n in (9, 30)]
        distance, end = d.myers(item, text)
        assert distance == slow(item, text)
        if distance < len(item):
            assert slow(item[::-1], text[:end][::-1]) == distance


def test_matcher_equals_brute_force():
    draw = random.Random(2)
    items = [(k, passage(draw, draw.choice([1, 2, 4, 5, 15, 40, 55]))) for k in range(12)]
    matcher = d.Matcher([(k, " ".join(w)) for k, w in items], 0.8)
    hits = 0
    for _ in range(60):
        text = passage(draw, draw.randrange(0, 80))
        for _ in range(draw.randrange(3)):
            _, item = draw.choice(items)
            at = draw.randrange(len(text) + 1)
            text[at:at] = damaged(draw, item, draw.randrange(d.budget(len(item)) + 3))
        found = {k: (distance, a, b) for k, distance, _, a, b in matcher.find("  ".join(text).title() + "!")}
        for k, item in items:
            best = slow(item, text)
            assert (k in found) == (best <= d.budget(len(item)))
            if k in found:
                distance, a, b = found[k]
                assert distance == best == slow(item, text[a:b])
                hits += 1
    assert hits > 50


def test_rows(spark):
    draw = random.Random(3)
    item = passage(draw, 30)
    items = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (None, "lone words of an item without id")], "item_id long, text string"
    )
    rows = [(1, "before. " + " ".join(damaged(draw, item, 4)).upper() + " after"), (2, " ".join(passage(draw, 80))), (None, "LONE words, of an item without id")]
    frame = docs(spark, rows).union(awkward(spark))
    for words in (d.BLOCK_WORDS, 10):  # one block, and a block per item
        got = sorted((str(r.doc_id), str(r.item_id), r.item_words) for r in d.matches(frame, items, block_words=words).collect())
        assert got == [("1", "1", 30), ("1", "1", 30), ("None", "None", 7)]
    assert d.uncontaminated(frame, items).count() == frame.count() - 2
    assert d.matches(empty(spark), items).count() == 0
    assert d.matches(frame, items.limit(0)).count() == 0
    assert d.uncontaminated(frame, items.limit(0)).count() == frame.count()
