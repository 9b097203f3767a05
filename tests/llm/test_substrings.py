import random
import re
from hashlib import sha256

import numpy as np
import pytest

from tests.llm.samples import awkward, docs, empty
from tidepanel.llm import substrings
from tidepanel.llm.catalog import op12

WORD = re.compile(r"[^ \t-\r]+")


def slow(rows, size=20):
    """Rows of one id are judged apart; a null id is the smallest."""
    order = lambda i: (i is not None, i or 0)
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), own in zip(rows, words):
        for s in range(len(own) - size + 1):
            key = tuple(own[s : s + size])
            first[key] = min(first.get(key, (True, 1 << 70)), order(i))
    out = []
    for (i, _), own in zip(rows, words):
        gone, seen = set(), set()
        for s in range(len(own) - size + 1):
            key = tuple(own[s : s + size])
            if first[key] < order(i) or key in seen:
                gone |= set(range(s, s + size))
            seen.add(key)
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((i, len(own), len(gone), sha256(kept.encode()).hexdigest(), gone))
    return out


def passages(seed, count=120):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["ä", "É\x85é", "中"]
    fresh = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    common = [fresh(n) for n in (19, 20, 21, 25, 40, 60, 200)]
    rows = []
    for i in range(count):
        words = []
        for _ in range(draw.randrange(1, 6)):
            piece = draw.choice(common) if draw.random() < 0.6 else fresh(draw.randrange(1, 50))
            cut = draw.randrange(0, max(1, len(piece) - 18))
            words += piece[cut:] if draw.random() < 0.3 else piece
            words += ["x"] * draw.choice([0, 0, 0, 30])
        rows.append((i, "".join(w + draw.choice([" ", " ", "\n", " \t "]) for w in words)))
    return rows


COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = passages(seed)
    got = sorted(tuple(r) for r in op12(docs(spark, rows)).select(COLUMNS).collect())
    assert got == sorted(r[:4] for r in slow(rows))


def test_hot_anchors_and_groups(spark):
    draw = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda i: " ".join(f"o{i}_{draw.randrange(9)}" for _ in range(30))
    rows = [(i, f"{own(i)} {passage} {own(i)}" if i % 3 == 0 else own(i)) for i in range(1500)]
    rows += [(5000 + i, passage) for i in range(700)]
    got = sorted(tuple(r) for r in op12(docs(spark, rows).repartition(20)).select(COLUMNS).collect())
    assert got == sorted(r[:4] for r in slow(rows))
    assert sum(r[2] for r in got) == (499 + 700) * 60


def test_repeats_are_maximal(spark):
    rows = passages(9, 60)
    want = {i: gone for i, *_, gone in slow(rows)}
    for r in substrings.deduplicated(docs(spark, rows)).collect():
        spans = [(s.start, s.start + s.length) for s in r.repeats]
        assert {k for s, e in spans for k in range(s, e)} == want[r.doc_id]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_equal_windows_choose_equal_anchors():
    draw = random.Random(3)
    for _ in range(50):
        common = [draw.choice("abcdefghijk") for _ in range(draw.randrange(20, 60))]
        left, right = (" ".join([*[draw.choice("xyz") for _ in range(draw.randrange(30))], *common, "end"]) for _ in range(2))
        units = substrings.Units([left.encode(), right.encode()])
        found = [{}, {}]
        unit, at, hashes = units.windows(np.arange(len(units.first)))
        for u, s, h in zip(unit, at, hashes):
            found[units.text[u]][int(h)] = int(units.anchor[u])
        both = found[0].keys() & found[1].keys()
        assert len(both) >= 1 and all(found[0][h] == found[1][h] for h in both)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    got = [tuple(r) for r in op12(awkward(spark)).select(COLUMNS).collect()]
    assert sorted(got, key=str) == sorted((r[:4] for r in slow(rows)), key=str)
    assert substrings.deduplicated(empty(spark)).count() == 0
