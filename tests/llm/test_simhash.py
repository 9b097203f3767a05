import random

import xxhash

from tests.llm.samples import awkward, docs, empty, text
from tidepanel.llm import graph, simhash


def slow_fingerprint(t):
    words = (t or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_groups(rows):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    pairs = [(i, j) for i, f in prints for j, g in prints if (f ^ g).bit_count() <= 4]
    return roots(pairs, [i for i, _ in prints])


def near_copies(seed, n):
    draw = random.Random(seed)
    base = text(seed, 300, 3).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2])):
            words[draw.randrange(len(words))] = draw.choice(["other", "New", "zzz"])
        out.append(" ".join(words))
    return out


def test_groups_equal_brute_force(spark):
    texts = near_copies(1, 60) + near_copies(2, 20) + [text(i) for i in range(40)] + ["", None, "one", "ONE", "one two three"]
    rows = [(1000 - 3 * k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.grouped(docs(spark, rows)).collect()}
    want = slow_groups(rows)
    for i, t in rows:
        assert got[i].fingerprint == f"{slow_fingerprint(t):016x}"
        assert got[i].component_id == want[i]


def test_links_between_random_neighbours(spark):
    draw = random.Random(5)
    prints = []
    for _ in range(60):
        base = draw.getrandbits(64)
        prints.append(base)
        for _ in range(4):
            flipped = prints[-1]
            for bit in draw.sample(range(64), draw.choice([1, 2, 4, 5])):
                flipped ^= 1 << bit
            prints.append(flipped)
    signed = [(p - (1 << 64) if p >> 63 else p, 1) for p in set(prints)]
    got = {r.bits: r.comp for r in simhash.linked(spark.createDataFrame(signed, "bits long, copies long")).collect()}
    full = [(b, b & (1 << 64) - 1) for b, _ in signed]
    want = roots([(a, b) for a, x in full for b, y in full if (x ^ y).bit_count() <= 4], [b for b, _ in full])
    assert got == want


def test_awkward_rows(spark):
    rows = simhash.grouped(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[4] == {("0" * 16, 2)}
    assert (slow := f"{slow_fingerprint(text(1)):016x}", None) in by[1] and (slow, None) in by[5]  # the null id is the smallest
    assert simhash.grouped(empty(spark)).count() == 0
    kept = simhash.one_of_each(docs(spark, [(1, text(1)), (2, text(1)), (3, text(3)), (4, None), (5, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_one_of_each_with_repeated_and_null_ids(spark):
    rows = [(1, text(1)), (1, text(1)), (1, text(1)), (None, text(2)), (None, text(2)), (7, text(2)), (1, text(3)), (9, text(3)), (2, None), (2, "")]
    kept = simhash.one_of_each(docs(spark, rows)).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == sorted([(1, text(1)), (0, text(2)), (1, text(3)), (2, "")])
    # A third of all rows is one row without an id.
    kept = simhash.one_of_each(docs(spark, [(None, text(5))] * 60 + [(k, text(100 + k)) for k in range(20)])).collect()
    assert len(kept) == 21
    frame = docs(spark, rows)
    assert simhash.one_of_each(frame).columns == frame.columns
    assert sorted(map(str, simhash.one_of_each(frame.repartition(5)).collect())) == sorted(map(str, simhash.one_of_each(frame).collect()))
    assert simhash.one_of_each(empty(spark)).count() == 0


def test_no_table_by_fingerprint_is_broadcast(spark, monkeypatch):
    plans = []
    components, written = simhash.components, simhash.written

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "components", lambda edges: components(kept(edges)))
    monkeypatch.setattr(simhash, "written", lambda df, name: written(kept(df), name))
    rows = [(k, t) for k, t in enumerate(near_copies(5, 10) + [text(i) for i in range(10)])]
    assert kept(simhash.grouped(docs(spark, rows))).count() == len(rows)
    assert kept(simhash.one_of_each(docs(spark, rows))).count() < len(rows)
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert sum("SortMergeJoin" in plan for plan in plans) >= 8
    # Left are members of components onto fingerprints, and kept rows onto texts: nothing keyed by segment or fingerprint.
    assert not [line for line in joins if "[t#" in line or "[bits#" in line]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 150)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
