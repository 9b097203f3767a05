"""Substring dedup: seed on winnowed anchors, extend both ways, keep maximal repeats.

Every window of ``WINDOW`` words chooses an anchor, the leftmost smallest hash among its runs of
``ANCHOR`` words, so equal windows choose equal anchors at the same place.  Consecutive windows with one
choice form a unit.  Texts meet on anchors; anchors found once are dropped at once.  Where an anchor
is shared, all its occurrences are extended together rather than pair by pair:

1. occurrences that agree over the whole unit are one class; all but its smallest document lose it;
2. where classes of one anchor differ (at the edges of a repeat), each class's first occurrence is
   extended to the left and right by every number of words a window allows; equal extensions meet and
   the smallest document keeps the window.

Lost windows that touch or overlap join into maximal repeats.  Work and rows grow with the number of
words, not with the square of a group; joins on anchors spread the few hot ones over salts.  Hashes
of anchor and of unit or window together have 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidepanel.llm.common import given_id, identified
from tidepanel.sources.storage import written

WINDOW, ANCHOR = 20, 8
#: Bytes of text read at a time; bounds a worker's memory (one text is never cut), not the result.
BYTES_AT_ONCE = 1_000_000
#: An anchor with more than one in HOT of all rows counts as hot, so there are at most HOT of them.
HOT, SALTS = 1000, 32
MEMBER, FIRST, OPEN, WON = 0, 1, 2, 3
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(count, base))])


class Rolling:
    """Hashes of any stretch of words that do not depend on where it stands."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        self.back = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(words))
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words))[:-1])])

    def __call__(self, at: np.ndarray, size) -> np.ndarray:
        return _mixed((self.prefix[at + size] - self.prefix[at]) * self.back[at] + np.asarray(size, np.uint64))


class Units:
    """The words of a batch of texts (UTF-8) and the units of their windows.

    Words: ``begin`` and ``end`` in ``data``, ``cuts`` between texts.  Units: ``text``, ``first`` and
    ``last`` window (numbers of their first words), hashes of ``anchor`` and of the whole ``unit``,
    and ``again`` where the same text had the same unit before.
    """

    def __init__(self, texts: list[bytes | None], window: int = WINDOW, anchor: int = ANCHOR):
        self.window = window
        joined = b" ".join(t or b"" for t in texts) + b" "
        self.data = np.frombuffer(joined, np.uint8)
        space = _SPACE[self.data]
        self.begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        self.end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.cuts = np.concatenate([[0], np.searchsorted(self.begin, ends)])
        self.words = Rolling(self._hashes(space), _BASES[1])
        starts = np.maximum(np.diff(self.cuts) - window + 1, 0)
        doc = np.repeat(np.arange(len(texts)), starts)
        at = _ranges(self.cuts[:-1], starts)
        if not len(at):
            self.text = self.first = self.last = np.zeros(0, np.int64)
            self.anchor = self.unit = np.zeros(0, np.uint64)
            self.again = np.zeros(0, bool)
            return
        grams = Rolling(self.hashes, _BASES[0])(np.arange(len(self.hashes) - anchor + 1), anchor)
        chosen = at + self._leftmost(grams, window - anchor + 1)[at]
        fresh = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])])
        opens = np.flatnonzero(fresh)
        self.text, self.first = doc[opens], at[opens]
        self.last = at[np.concatenate([opens[1:], [len(at)]]) - 1]
        self.anchor = grams[chosen[opens]]
        self.unit = self.words(self.first, self.last - self.first + window)
        self.again = repeated(self.text, self.anchor, self.unit)

    def _hashes(self, space: np.ndarray) -> np.ndarray:
        if not len(self.begin):
            self.hashes = np.zeros(0, np.uint64)
            return self.hashes
        size = self.end - self.begin
        power = _powers(_BASES[0], int(size.max()))
        value = np.zeros(len(self.data), np.uint64)
        inside = ~space
        value[inside] = (self.data[inside].astype(np.uint64) + np.uint64(1)) * power[_ranges(np.zeros(len(size), np.int64), size)]
        self.hashes = _mixed(np.add.reduceat(value, self.begin) + size.astype(np.uint64))
        return self.hashes

    @staticmethod
    def _leftmost(grams: np.ndarray, width: int) -> np.ndarray:
        """Offset of the smallest of ``width`` hashes from each on; the low bits give way to the offset."""
        mask = np.uint64((1 << (width - 1).bit_length()) - 1)
        high, count = grams & ~mask, len(grams) - width + 1
        best = high[:count].copy()
        for j in range(1, width):
            np.minimum(best, high[j : count + j] | np.uint64(j), out=best)
        return (best & mask).astype(np.int64)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, first word and hash of every window of the chosen units: all extensions of their anchors."""
        sizes = self.last[chosen] - self.first[chosen] + 1
        at = _ranges(self.first[chosen], sizes)
        return np.repeat(chosen, sizes), at, self.words(at, self.window)


def repeated(*keys: np.ndarray) -> np.ndarray:
    """True for rows whose keys an earlier row has too."""
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batched(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Arrow columns made by ``work(columns, texts)`` from slices of rows whose second column holds bytes."""
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            group = np.cumsum([len(t or b"") + 64 for t in sizes]) // BYTES_AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:]):
                if s < e:
                    part = batch.slice(s, e - s)
                    yield pa.RecordBatch.from_arrays(work(part, part.column(1).to_pylist()), schema=arrow)

    return df.mapInArrow(run, kind)


def _texts(docs: DataFrame) -> DataFrame:
    return identified(docs, "text").select("id", F.col("text").cast("binary").alias("text"))


def _anchors(part: pa.RecordBatch, texts: list) -> list[pa.Array]:
    units = Units(texts)
    return [_signed(units.anchor[~units.again])]


def _units(part: pa.RecordBatch, texts: list) -> list[pa.Array]:
    units = Units(texts)
    once = ~units.again
    ids = part.column(0).to_numpy()[units.text[once]]
    return [_signed(units.anchor[once]), _signed(units.unit[once]), pa.array(ids)]


def _marked(part: pa.RecordBatch, units: Units) -> dict[int, np.ndarray]:
    """Per kind of mark, mixed keys of (text, hash); hashes meet only those of their own text."""
    marks = part.column(2)
    sizes = np.diff(marks.offsets.to_numpy())
    flat = marks.flatten()
    keys = flat.field("key").to_numpy(zero_copy_only=False).view(np.uint64)
    kinds = flat.field("kind").to_numpy(zero_copy_only=False)
    keys = _own(np.repeat(np.arange(len(sizes)), sizes), keys)
    return {k: keys[kinds == k] for k in (MEMBER, FIRST, OPEN, WON)}


def _own(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    return _mixed(key + text.astype(np.uint64) * _BASES[1])


def _extended(part: pa.RecordBatch, texts: list) -> list[pa.Array]:
    """Every extension of the anchors that are still open."""
    units = Units(texts)
    marks = _marked(part, units)
    chosen = np.flatnonzero(~units.again & np.isin(_own(units.text, units.unit), marks[OPEN]))
    unit, _, hashes = units.windows(chosen)
    once = ~repeated(units.text[unit], units.anchor[unit], hashes)
    unit, hashes = unit[once], hashes[once]
    return [_signed(units.anchor[unit]), _signed(hashes), pa.array(part.column(0).to_numpy()[units.text[unit]])]


def _judged(part: pa.RecordBatch, texts: list) -> list[pa.Array]:
    """Word count, lost words, maximal repeats and the text that is left."""
    units = Units(texts)
    marks, own = _marked(part, units), _own(units.text, units.unit)
    lost = units.again | (np.isin(own, marks[MEMBER]) & ~np.isin(own, marks[FIRST]) & ~np.isin(own, marks[OPEN]))
    unit, at, hashes = units.windows(np.flatnonzero(~lost & np.isin(own, marks[OPEN])))
    later = repeated(units.text[unit], units.anchor[unit], hashes) | ~np.isin(_own(units.text[unit], hashes), marks[WON])
    begin, end = np.concatenate([units.first[lost], at[later]]), np.concatenate([units.last[lost], at[later]]) + units.window
    depth = np.bincount(begin, minlength=len(units.begin) + 1) - np.bincount(end, minlength=len(units.begin) + 1)
    gone = np.cumsum(depth)[:-1] > 0
    kept, cuts = ~gone, units.cuts
    sizes = (units.end - units.begin + 1) * kept
    after = units.data[_ranges(units.begin, sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    after[offsets[1:][kept] - 1] = 32
    text_at = offsets[cuts]
    left = [after[s : max(s, e - 1)].tobytes() for s, e in zip(text_at[:-1].tolist(), text_at[1:].tolist())]
    edge = np.zeros(len(gone) + 1, bool)
    edge[cuts] = True
    before = np.concatenate([[False], gone[:-1]])
    opens = np.flatnonzero(gone & (~before | edge[:-1]))
    closes = np.flatnonzero(gone & (~np.concatenate([gone[1:], [False]]) | edge[1:])) + 1
    holder = np.searchsorted(opens, cuts)
    home = np.repeat(cuts[:-1], np.diff(holder))
    repeats = pa.StructArray.from_arrays([pa.array(opens - home), pa.array(closes - opens)], ["start", "length"])
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[cuts])
    spans = pa.ListArray.from_arrays(pa.array(holder.astype(np.int32)), repeats)
    return [part.column(0), pa.array(np.diff(cuts)), pa.array(removed), spans, pa.array(left, pa.binary())]


def spread(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, id, …) whose key is in ``counts`` (key, n), n being the key's rows among ``rows``.

    Keys with more than a thousandth of the rows, at most a thousand, are broadcast; their rows are
    dealt over salts and their counts repeated per salt.  All others meet in a plain join.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > total // HOT).select(key, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = F.when(F.col("n") > total // HOT, SALTS - 1).otherwise(0)
    met = counts.select(key, F.explode(F.sequence(F.lit(0), copies)).alias("_salt"))
    return dealt.join(met, [key, "_salt"]).drop("_salt", "_hot")


def _by_document(marks: DataFrame) -> DataFrame:
    """All marks of an id in one row; one exchange, since they are dealt before they are collected."""
    packed = F.collect_list(F.struct("key", "kind")).alias("marks")
    return marks.repartition("id").groupBy("id").agg(packed)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without words that repeat an earlier passage.

    Returns doc_id, n_words, n_removed, repeats (start and length of each maximal removed stretch, in
    words) and text (the other words, joined by single spaces).  A word goes if a window of twenty
    words around it also starts in a smaller doc_id or earlier in the same row; windows are judged on
    the input.  A null or empty text has no words.  A null id is smaller than any other.  Rows that
    share an id are judged apart and none of them is earlier than the other.  Other columns are not
    read; an empty table gives an empty table; texts are read whole.
    """
    texts = _texts(docs)
    anchors = _batched(texts, _anchors, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    shared = written(anchors.where("n > 1"), "shared_anchors")
    units = _batched(texts, _units, "anchor long, unit long, id long")
    members = written(spread(units, shared, "anchor"), "members")
    firsts = written(members.groupBy("anchor", "unit").agg(F.min("id").alias("id")), "classes")
    unlike = written(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "unlike_anchors")
    mark = lambda df, key, kind: df.select("id", F.col(key).alias("key"), F.lit(kind).cast("byte").alias("kind"))
    opened = written(mark(spread(firsts, unlike, "anchor"), "unit", OPEN), "open")
    extended = _batched(texts.join(_by_document(opened), "id"), _extended, "anchor long, window long, id long")
    won = extended.groupBy("anchor", "window").agg(F.min("id").alias("id"))
    marks = mark(members, "unit", MEMBER).unionAll(mark(firsts, "unit", FIRST)).unionAll(opened).unionAll(mark(won, "window", WON))
    none = F.array().cast("array<struct<key:long,kind:byte>>")
    met = texts.join(_by_document(marks), "id", "left").select("id", "text", F.coalesce("marks", none).alias("marks"))
    schema = "id long, n_words long, n_removed long, repeats array<struct<start:long,length:long>>, text binary"
    out = _batched(met, _judged, schema)
    return out.select(given_id().alias("doc_id"), "n_words", "n_removed", "repeats", F.decode("text", "UTF-8").alias("text"))
