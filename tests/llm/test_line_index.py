import random
from hashlib import sha256

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tests.llm.samples import awkward, docs, empty
from tidepanel.llm import line_index
from tidepanel.llm.catalog import ORACLE

SPACES = " \t\n\x0b\x0c\r"


def slow(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))
    owners = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            owners.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(owners[key(x)]) < 2 or min(owners[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def rows_of(seed, ids):
    draw = random.Random(seed)
    pool = [f"Shared line number {k} É" for k in range(12)] + ["short", "", "  \t", "exactly10c"]
    vary = lambda s: draw.choice([s, s.upper() if s.isascii() else s, f"  {s}\t", s])
    return [(i, "\n".join(vary(draw.choice(pool)) if draw.random() < 0.7 else f"own line {i} {draw.random()}" for _ in range(draw.randrange(1, 9)))) for i in ids]


def state(index, frame):
    return sorted(tuple(r) for r in line_index.cleaned(index, frame).collect())


def test_equals_brute_force_and_sql(spark):
    rows = rows_of(1, range(60)) + [(99, None), (98, "")]
    frame = docs(spark, rows)
    got = sorted(tuple(r) for r in line_index.dedup(frame).collect())
    assert got == slow(rows)
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text").toPandas())
    sql = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({ORACLE['op5_line_dedup']})").fetchall())
    assert sql == sorted((i, n, d, sha256(t.encode()).hexdigest()) for i, t, n, d in got)


def test_insertions_and_deletions_are_reversible(spark):
    first, second, third = rows_of(2, range(0, 20)), rows_of(3, range(20, 40)), rows_of(4, range(-10, 0))
    index = line_index.build(docs(spark, first), keys_per_shard=20)
    assert index.shards > 1
    before = state(index, docs(spark, first))
    assert before == slow(first)
    grown = line_index.insert(line_index.insert(index, docs(spark, second)), docs(spark, third))
    everything = first + second + third
    assert state(grown, docs(spark, everything)) == slow(everything)
    gone = spark.createDataFrame([(i,) for i, _ in second + third] + [(12345,)], "doc_id long")
    back = line_index.delete(grown, gone)
    assert state(back, docs(spark, first)) == before
    assert sorted(map(tuple, back.counts.select("key", "refs", "owner").collect())) == sorted(
        map(tuple, index.counts.select("key", "refs", "owner").collect())
    )
    again = line_index.insert(back, docs(spark, second))
    assert state(again, docs(spark, first + second)) == slow(first + second)


def test_filter_keeps_what_it_holds():
    draw = random.Random(1)
    keys = [draw.getrandbits(64) for _ in range(4000)]
    made = line_index.CuckooFilter(256)  # far too small: what finds no place stays in the rest
    for k in keys[:1500]:
        made.add(k)
    assert made.rest and all(k in made for k in keys[:1500])
    for k in keys[:700]:
        made.remove(k)
    assert all(k in made for k in keys[700:1500])
    roomy = line_index.CuckooFilter.planned(4000)
    for k in keys[:2000]:
        roomy.add(k)
    assert not roomy.rest and sum(k in roomy for k in keys[2000:]) < 10
    cells, rest = made.dump()
    assert all(k in line_index.CuckooFilter.load(cells, rest) for k in keys[700:1500])


def test_awkward_rows(spark):
    rows = line_index.dedup(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_lines, r.n_dropped, r.text) for r in by[2]] == [(1, 0, "")]
    assert by[5][0].n_dropped == 3 and by[1][0].n_dropped == 3  # the row without an id is the smallest document
    assert line_index.dedup(empty(spark)).count() == 0
    replaced = line_index.replaced(line_index.build(awkward(spark)), awkward(spark))
    assert replaced.columns == awkward(spark).columns and replaced.count() == awkward(spark).count()


def test_filters_decide_what_is_merged(spark, monkeypatch):
    """A key of one document never reaches the merge unless a filter takes it for a known one."""
    rows = rows_of(5, range(80))
    monkeypatch.setattr(line_index, "LOAD", 0.95)
    index = line_index.nothing(spark, keys_per_shard=20)
    posted = line_index.postings(docs(spark, rows))
    index = line_index._with_room(index, posted)
    asked = [r for r in line_index._asked(index, posted).collect() if r.key is not None]
    holders = {bytes(r.key): r.n for r in posted.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert {k for k, n in holders.items() if n > 1 and sum(bytes(r.key) == k for r in asked) > 1} <= {bytes(r.key) for r in asked if r.maybe}
    alone = [r for r in asked if holders[bytes(r.key)] == 1]
    assert len(alone) > 50 and sum(r.maybe for r in alone) <= 2
    monkeypatch.setattr(line_index.CuckooFilter, "known", lambda self, hashes: np.ones(len(hashes), bool))
    # Filters that know everything cost merges, yet change no decision.
    assert sorted(map(tuple, line_index.cleaned(line_index.build(docs(spark, rows)), docs(spark, rows)).collect())) == slow(rows)


def test_false_hits_end_in_the_filters(spark):
    """Filters of very few buckets give false hits; every live key is known all the same, also after deletions."""
    rows = [(i, "\n".join(f"line {i} of a document {k}" for k in range(40))) for i in range(30)]
    index = line_index.insert(line_index.build(docs(spark, rows[:10]), keys_per_shard=2000), docs(spark, rows[10:]))
    index = line_index.delete(index, spark.createDataFrame([(i,) for i in range(5)], "doc_id long"))
    filters = {r.shard: line_index.CuckooFilter.load(bytes(r.cells), bytes(r.rest)) for r in index.filters.collect()}
    live = index.counts.collect()
    assert len(live) == 25 * 40
    hashes = [int.from_bytes(bytes(r.key)[:8], "big") for r in live]
    assert all(h in filters[r.shard] for h, r in zip(hashes, live))
    assert all(filters[r.shard].known(np.array([h], np.uint64))[0] for h, r in zip(hashes, live))
    assert sum(int((f.cells > 0).sum()) + len(f.rest) for f in filters.values()) == len(live)


def test_large_insert_deals_the_shards_first(spark):
    few, lots = rows_of(6, range(3)), [(100 + i, "\n".join(f"another line {i} {k}" for k in range(30))) for i in range(20)]
    index = line_index.insert(line_index.build(docs(spark, few), keys_per_shard=25), docs(spark, lots))
    assert index.shards >= 20
    assert state(index, docs(spark, few + lots)) == slow(few + lots)
