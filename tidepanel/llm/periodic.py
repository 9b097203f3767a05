"""Periodic runs: stretches of words that repeat themselves with some period.

A run is a stretch of at least ``least`` words and two periods whose words one (smallest) period
apart are equal, and that no neighbouring word extends.  A word of a run occurs at least twice in
it, so a word that occurs once in a segment lies in no run there and splits it; the parts are split
again until nothing changes.  What survives is scanned lag by lag: a run of period q holds a stretch
of matches at lag q, which covers a whole block of an even grid about half as long, so only the
grid's blocks are compared (by prefix hashes), hits are extended both ways by bisection and every
result is verified word by word.  Lags are taken an octave at a time over all segments and texts of
a batch together, n log n comparisons in all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidepanel.llm.common import given_id, identified

LEAST_WORDS = 12
#: Words searched at a time; bounds a worker's memory (one text is never cut), not the result.
WORDS_AT_ONCE = 200_000
WORD = re.compile(r"[^ \t-\r]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of the previous and the next equal id; -1 and len(ids) where there is none."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before, after = np.full(len(ids), -1), np.full(len(ids), len(ids))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def segments(ids: np.ndarray, cuts: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments, within the given cuts, in which every word occurs twice or more."""
    before, after = _neighbours(ids)
    starts, ends, stable = cuts[:-1], cuts[1:], []
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        sizes = ends - starts
        at = _ranges(starts, sizes)
        kept = (before[at] >= np.repeat(starts, sizes)) | (after[at] < np.repeat(ends, sizes))
        first = np.cumsum(sizes) - sizes
        whole = np.logical_and.reduceat(kept, first)
        stable.append((starts[whole], ends[whole]))
        again = np.repeat(~whole, sizes) & kept
        opens = again & ~np.concatenate([[False], again[:-1]])
        closes = again & ~np.concatenate([again[1:], [False]])
        opens[first] = again[first]  # neighbouring segments are not one
        closes[first[1:] - 1] = again[first[1:] - 1]
        starts, ends = at[opens], at[closes] + 1
    if not stable:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = (np.concatenate(x) for x in zip(*stable))
    order = np.argsort(starts)
    return starts[order], ends[order]


class _Equal:
    """Equality of two stretches of words by prefix sums of mixed ids times powers of an odd base."""

    def __init__(self, ids: np.ndarray):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(ids), _BASE))])
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.power[:-1])])

    def __call__(self, at: np.ndarray, size: np.ndarray, lag: np.ndarray) -> np.ndarray:
        here = self.prefix[at + size] - self.prefix[at]
        return here * self.power[lag] == self.prefix[at + size + lag] - self.prefix[at + lag]

    def reach(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words, at most ``most``, match at the lag from ``at`` onwards (step 1) or before it (-1)."""
        low, high = np.zeros_like(at), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self(at if step > 0 else at - middle, middle, lag)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low


def _octave(ids, equal, starts, ends, lags, least) -> list[np.ndarray]:
    """(start, end, lag) of the maximal matching stretches long enough for a run, at every lag given."""
    need = np.maximum(lags, least - lags)
    block = (need + 1) // 2
    seg = np.repeat(np.arange(len(starts)), len(lags))
    lag, block = np.tile(lags, len(starts)), np.tile(block, len(starts))
    count = np.maximum((ends - starts)[seg] - lag, 0) // block
    grid = np.repeat(np.arange(len(seg)), count)
    step = _ranges(np.zeros(len(seg), np.int64), count)
    at = starts[seg[grid]] + step * block[grid]
    hit = np.flatnonzero(ids[at] == ids[at + lag[grid]])
    hit = hit[equal(at[hit], block[grid[hit]], lag[grid[hit]])]
    if not len(hit):
        return []
    fresh = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (grid[hit[1:]] != grid[hit[:-1]])])
    final = np.concatenate([fresh[1:], [True]])
    grid, left, right = grid[hit[fresh]], at[hit[fresh]], at[hit[final]] + block[grid[hit[final]]]
    lag, block, low, high = lag[grid], block[grid], starts[seg[grid]], ends[seg[grid]]
    left = left - equal.reach(left, lag, np.minimum(block - 1, left - low), -1)
    right = right + equal.reach(right, lag, np.minimum(block - 1, high - lag - right), 1)
    length = right - left + lag
    good = length >= np.maximum(least, 2 * lag)
    return [left[good], right[good] + lag[good], lag[good]]


def _plain(ids, starts, ends, least) -> list[np.ndarray]:
    """The same stretches by comparing every word at every lag; for input that defeats the hashes."""
    out = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        for lag in range(1, (e - s) // 2 + 1):
            edge = np.diff(np.concatenate([[False], ids[s : e - lag] == ids[s + lag : e], [False]]).astype(np.int8))
            left, right = np.flatnonzero(edge == 1) + s, np.flatnonzero(edge == -1) + s + lag
            good = right - left >= max(least, 2 * lag)
            out.append([left[good], right[good], np.full(int(good.sum()), lag)])
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _smallest(found: list[np.ndarray]) -> list[np.ndarray]:
    """A stretch found at several lags has the smallest as its period."""
    start, end, lag = found
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    order = np.lexsort((lag[first], start[first]))
    return [x[first][order] for x in (start, end, lag)]


def find_runs(ids: np.ndarray, cuts: np.ndarray, least: int = LEAST_WORDS) -> list[np.ndarray]:
    """Start, end and period of every run, by start and period; ids of different texts must differ."""
    starts, ends = segments(ids, cuts, least)
    equal, found, q = _Equal(ids), [], 1
    begin, stop = starts, ends
    while True:
        able = stop - begin >= max(least, 2 * q)
        begin, stop = begin[able], stop[able]
        if not len(begin):
            break
        lags = np.arange(q, min(2 * q, int((stop - begin).max()) // 2 + 1))
        found.append(_octave(ids, equal, begin, stop, lags, least))
        q *= 2
    found = [f for f in found if f]
    if not found:
        return [np.zeros(0, np.int64)] * 3
    start, end, lag = _smallest([np.concatenate(x) for x in zip(*found)])
    at, apart = _ranges(start, end - start - lag), np.repeat(lag, end - start - lag)
    if (ids[at] != ids[at + apart]).any():
        return _smallest(_plain(ids, starts, ends, least))
    return [start, end, lag]


def _searched(texts: list[str | None], least: int) -> list[tuple]:
    """Per text: word count, runs, and the words left when each run keeps its first period."""
    words = [WORD.findall(t or "") for t in texts]
    ids, total = [], 0
    for own in words:
        known = dict.fromkeys(own)
        for n, word in enumerate(known, total):
            known[word] = n
        ids.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        total += len(known)
    cuts = np.concatenate([[0], np.cumsum([len(own) for own in words])]).astype(np.int64)
    start, end, period = find_runs(np.concatenate(ids) if ids else np.zeros(0, np.int64), cuts, least)
    depth = np.zeros(int(cuts[-1]) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    dropped = np.cumsum(depth) > 0
    doc = np.searchsorted(start, cuts)
    out = []
    for n, own in enumerate(words):
        base, (r0, r1) = int(cuts[n]), doc[n : n + 2]
        runs = [
            {"start": s - base, "length": e - s, "period": p}
            for s, e, p in zip(start[r0:r1].tolist(), end[r0:r1].tolist(), period[r0:r1].tolist())
        ]
        kept = own if r0 == r1 else [own[i] for i in np.flatnonzero(~dropped[base : base + len(own)]).tolist()]
        out.append((len(own), runs, " ".join(kept)))
    return out


SCHEMA = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def detected(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period) and the collapsed text.

    Runs are ordered by start, then period; ``collapsed`` joins with single spaces the words that no
    run holds after its first period.  A null or empty text has no words and no runs.  Rows that
    repeat an id are searched each; overlapping runs of different periods are all listed; other
    columns are not read; an empty table gives an empty table; texts are searched whole.
    """
    kind = T.StructType.fromDDL(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)

        def rows(held):
            made = [(i, *r) for (i, _), r in zip(held, _searched([t for _, t in held], least))]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

        for batch in batches:
            held, size = [], 0
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                held.append((batch.column(0)[at].as_py(), text))
                size += 1 + len(text or "") // 6
                if size >= WORDS_AT_ONCE:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    out = identified(docs, "text").mapInArrow(run, kind)
    return out.select(given_id().alias("doc_id"), *out.columns[1:])
