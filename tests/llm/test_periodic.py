import random
import re
import time
from hashlib import sha256
from zlib import crc32

import numpy as np

from tests.llm.samples import awkward, docs, empty, text
from tidepanel.llm import periodic
from tidepanel.llm.catalog import op11, op11_planted


def slow(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def fast(words, least=12):
    return [tuple(r.values()) for r in periodic._searched([" ".join(words)], least)[0][1]]


def stuttering(draw):
    words = []
    while len(words) < draw.choice([0, 11, 12, 13, 40, 300]):
        kind = draw.random()
        piece = [draw.choice("abcdefgh"[: draw.choice([1, 2, 3, 8])]) for _ in range(draw.randrange(1, 9))]
        words += piece * draw.choice([1, 2, 3, 7]) if kind < 0.7 else [f"own{draw.random()}"] if kind < 0.8 else words[-30:]
    return words


def test_equals_brute_force():
    draw = random.Random(4)
    for _ in range(600):
        words = stuttering(draw)
        assert fast(words) == slow(words)
        assert fast(words, 4) == slow(words, 4)


def test_batches_keep_texts_apart():
    draw = random.Random(5)
    made = [stuttering(draw) for _ in range(80)] + [["x"] * 20, ["x"] * 20, []]
    for words, (n, runs, collapsed) in zip(made, periodic._searched([" ".join(m) for m in made], 12)):
        want = slow(words)
        assert n == len(words) and [tuple(r.values()) for r in runs] == want
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_splitting_recurses():
    # "u" splits; then "a" and "b" are alone in their parts and split them again
    words = "a x x x x x x x x x x x x u b y y a b".split()
    ids = np.array([sorted(set(words)).index(w) for w in words])
    starts, ends = periodic.segments(ids, np.array([0, len(words)]))
    assert list(zip(starts, ends)) == [(1, 13)]


def test_hash_collisions_are_harmless(monkeypatch):
    monkeypatch.setattr(periodic._Equal, "__call__", lambda self, at, size, lag: np.ones(len(at), bool))
    words = ("a b c " * 8 + "d e f a b c d e g " * 3).split()
    assert fast(words) == slow(words)


def test_long_texts_end():
    thue = [0]
    while len(thue) < 1 << 16:
        thue += [1 - x for x in thue]
    fib = ["a", "ab"]
    while len(fib[-1]) < 60_000:
        fib.append(fib[-1] + fib[-2])
    begun = time.time()
    assert fast(["w"] * 300_000) == [(0, 300_000, 1)]
    assert fast(list("abcdefg" * 30_000)) == [(0, 210_000, 7)]
    assert len(fast([str(x) for x in thue])) > 0
    assert len(fast(list(fib[-1]))) > 10_000
    assert time.time() - begun < 60


def expected(i, t):
    words = re.findall(r"[^ \t-\r]+", t or "")
    n = len(words)
    h = None if i is None else crc32(str(i).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = slow(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice([" ".join(stuttering(draw)), text(i), text(i, 3)])) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate(["", None, "one", "É\x1cÉ É\x85 x\x0by"])]
    got = sorted(tuple(r) for r in op11(docs(spark, rows)).select(COLUMNS).collect())
    assert got == sorted(expected(i, t) for i, t in rows)
    planted = {r.doc_id for r in op11_planted(docs(spark, rows)).collect() if r.text != dict(rows)[r.doc_id]}
    assert planted and all(crc32(str(i).encode()) % 10 == 0 for i in planted)


def test_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect() if r.doc_id != 7]
    got = [tuple(r) for r in op11(awkward(spark)).select(COLUMNS).collect()]
    assert sorted((g for g in got if g[0] != 7), key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert [g[1:6] for g in got if g[0] == 7] == [(1, 0, 30000, 1, 30_000_000)]
    assert periodic.detected(empty(spark)).count() == 0
