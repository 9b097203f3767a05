import random
import zlib
from collections import Counter

import pytest

from tests.llm.samples import awkward, docs, empty, text
from tidepanel.llm import shards


def checked(rows, given, n):
    assert len(rows) == len(given)
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(j, 0) for j in range(n)]
    assert max(sizes) - min(sizes) <= 1
    for j in range(n):
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(sizes[j]))
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in given)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def cut(rows, texts):
    spread = Counter((texts[r.doc_id], r.shard) for r in rows)
    groups = Counter(texts[r.doc_id] for r in rows)
    pairs = lambda n: n * (n - 1) // 2
    return sum(map(pairs, groups.values())) - sum(map(pairs, spread.values()))


def test_groups_gather_and_counts_stay_even(spark):
    draw = random.Random(1)
    given = [(k, text(k if draw.random() < 0.6 else 10_000 + draw.randrange(60), 12)) for k in range(403)]
    frame = docs(spark, given)
    rows = shards.sharded(frame, shards=8).collect()
    checked(rows, frame.collect(), 8)
    assert cut(rows, dict(given)) == 0
    again = shards.sharded(frame.repartition(5), shards=8).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in rows)


def test_a_text_with_a_third_of_all_rows(spark):
    given = [(k, "hot" if k % 3 == 0 else text(k, 12)) for k in range(300)]
    frame = docs(spark, given)
    rows = shards.sharded(frame, shards=10).collect()
    checked(rows, frame.collect(), 10)
    hot = Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert sum(n * (n - 1) // 2 for n in hot.values()) > 4 * sum([10 * 9 // 2] * 10) / 4  # better than spread evenly


@pytest.mark.parametrize("n", [1, 40])
def test_awkward_rows(spark, n):
    frame = awkward(spark)
    checked(shards.sharded(frame, shards=n).collect(), frame.collect(), n)
    if n == 40:
        assert shards.sharded(empty(spark)).count() == 0


def test_every_text_twice_or_more(spark):
    given = [(k, text(k // 2 if k < 480 else 10_000 + k // 3, 12)) for k in range(960)]
    frame = docs(spark, given)
    rows = shards.sharded(frame, shards=4).collect()
    checked(rows, frame.collect(), 4)
    whole = sum(n * (n - 1) // 2 for n in Counter(dict(given).values()).values())
    assert cut(rows, dict(given)) <= 0.02 * whole


def test_moves_into_full_shards_are_netted():
    assert shards.flows({(0, 1, 0): 5, (1, 2, 0): 3, (2, 0, 1): 4}, [0, 0, 0]) == {(0, 1): 3, (1, 2): 3, (2, 0): 3}
    draw = random.Random(3)
    for _ in range(50):
        asked = {(a, b, draw.randrange(3)): draw.randrange(1, 9) for a in range(6) for b in range(6) if a != b and draw.random() < 0.6}
        room = [draw.choice([0, 0, 2]) for _ in range(6)]
        most = Counter()
        for (a, b, _), n in asked.items():
            most[a, b] += n
        may = shards.flows(asked, room)
        assert all(n <= most[way] for way, n in may.items())
        for j in range(6):
            assert sum(n for (_, b), n in may.items() if b == j) - sum(n for (a, _), n in may.items() if a == j) <= room[j]


def test_a_text_that_fits_in_one_shard_is_in_one(spark):
    given = [(k, f"hot {k % 6}" if k < 180 else text(k, 12)) for k in range(400)]
    rows = shards.sharded(docs(spark, given), shards=10).collect()
    assert cut(rows, dict(given)) == 0
    given = [(k, "hot" if k < 250 else text(k // 2, 12)) for k in range(400)]
    rows = shards.sharded(docs(spark, given), shards=10).collect()
    assert len({r.shard for r in rows if r.doc_id < 250}) == 7
