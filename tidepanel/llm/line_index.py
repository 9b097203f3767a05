"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

The index has three tables, split into shards by the line key's hash:

* ``postings`` (key, id, lines): which document holds which key, and how often;
* ``counts`` (key, shard, refs, owner): in how many documents a key lives, and the smallest of them;
* ``filters`` (shard, cells, rest): a cuckoo filter of the shard's live keys.

Inserting documents asks the filters first: a key that they do not know is certainly new and is
appended without touching the exact counts; only the others (true repeats and the filters' rare
false hits) are merged with the counts.  ``build`` is an insertion into an empty index.  Documents
come in ``PIECES`` groups by a hash of their id, one after the other within a shard, so that a key
that lives in many documents is asked about at most so many times.  Deleting documents lowers the counts, hands ownership to
the next smallest document and takes keys that nobody holds any more out of the filters, so that
an insertion followed by its deletion restores every decision.  The decisions themselves always
come from the exact tables.

A line's key is the line without white space at its ends, with A-Z in lower case; keys of fewer
than ten code points are never dropped.  Keys are held as SHA-256 digests.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import NULL_ID, SPACES, given_id, identified, mapped
from tidepanel.sources.storage import written

LEAST_LENGTH = 10
#: Live keys of one shard that a filter is planned for; the number of shards follows the key count.
KEYS_PER_SHARD = 50_000
SLOTS, MOST_KICKS, LOAD = 4, 200, 0.85
#: Groups of documents that an insertion asks the filters about in turn.
PIECES = 16


class CuckooFilter:
    """16-bit fingerprints in buckets of four; what finds no place stays in an exact rest."""

    def __init__(self, buckets: int, cells: np.ndarray | None = None, rest: list[int] | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells
        self.rest = set(rest or ())

    @staticmethod
    def planned(keys: int) -> "CuckooFilter":
        return CuckooFilter(1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / LOAD)))))

    @staticmethod
    def load(cells: bytes, rest: bytes) -> "CuckooFilter":
        table = np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy()
        return CuckooFilter(len(table), table, np.frombuffer(rest, np.uint64).tolist())

    def dump(self) -> tuple[bytes, bytes]:
        return self.cells.tobytes(), np.array(sorted(self.rest), np.uint64).tobytes()

    def _place(self, h: int) -> tuple[int, int, int]:
        mark = (h >> 48 & 0xFFFF) or 1
        first = h & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def __contains__(self, h: int) -> bool:
        mark, a, b = self._place(h)
        return bool((self.cells[a] == mark).any() or (self.cells[b] == mark).any()) or h in self.rest

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each of ``hashes`` (uint64) may be held."""
        mark = np.maximum(hashes >> np.uint64(48), np.uint64(1))
        first = hashes & np.uint64(self.buckets - 1)
        other = first ^ (mark * np.uint64(0x5BD1E995) & np.uint64(self.buckets - 1))
        wanted = mark.astype(np.uint16)[:, None]
        hit = (self.cells[first] == wanted).any(1) | (self.cells[other] == wanted).any(1)
        if self.rest:
            hit |= np.isin(hashes, np.array(sorted(self.rest), np.uint64))
        return hit

    def add(self, h: int) -> None:
        mark, a, b = self._place(h)
        for bucket in (a, b):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return
        path, bucket = [], a
        for kick in range(MOST_KICKS):
            slot = (mark + kick) % SLOTS
            path.append((bucket, slot, int(self.cells[bucket, slot])))
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return
        for bucket, slot, was in reversed(path):
            self.cells[bucket, slot] = was
        self.rest.add(h)

    def remove(self, h: int) -> None:
        """Take out a key that was added; other keys with the same fingerprint stay."""
        if h in self.rest:
            self.rest.remove(h)
            return
        mark, a, b = self._place(h)
        for bucket in (a, b):
            at = np.flatnonzero(self.cells[bucket] == mark)
            if len(at):
                self.cells[bucket, at[0]] = 0
                return


@dataclass
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    keys_per_shard: int = KEYS_PER_SHARD


def line_key(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(SPACES)), upper, upper.lower())


def _digest(key: Column) -> Column:
    return F.unhex(F.sha2(key, 256))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def postings(docs: DataFrame) -> DataFrame:
    """(key, id, lines): every key of at least ten code points in every document."""
    rows = identified(docs, "text").select("id", F.explode(_lines(F.col("text"))).alias("line"))
    keyed = rows.select("id", line_key(F.col("line")).alias("k")).where(F.length("k") >= LEAST_LENGTH)
    return keyed.select(_digest(F.col("k")).alias("key"), "id").groupBy("key", "id").agg(F.count(F.lit(1)).alias("lines"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _hashes(keys: pd.Series) -> np.ndarray:
    """The first eight bytes of every 32-byte key."""
    return np.frombuffer(b"".join(keys), ">u8")[::4].astype(np.uint64)


def _counted(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("key", *more).agg(F.count(F.lit(1)).alias("refs"), F.min("id").alias("owner"))


def _load(filters: pd.DataFrame, keys: int) -> CuckooFilter:
    if filters.empty:
        return CuckooFilter.planned(keys)  # a shard that held no key so far
    return CuckooFilter.load(filters["cells"].iloc[0], filters["rest"].iloc[0])


def _row(shard: int, made: CuckooFilter) -> pd.DataFrame:
    cells, rest = made.dump()
    return pd.DataFrame({"shard": [shard], "cells": [cells], "rest": [rest]})


def nothing(spark: SparkSession, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
    """An index without documents."""
    return LineIndex(
        spark.createDataFrame([], "key binary, id long, lines long"),
        spark.createDataFrame([], "key binary, refs long, owner long, shard int"),
        spark.createDataFrame([], "shard int, cells binary, rest binary"),
        0,
        keys_per_shard,
    )


def build(docs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
    """The index of ``docs`` (doc_id, text): all of them inserted into an empty one.

    A null or empty text is one empty line and holds no key.  Rows that repeat a doc_id are one
    document; rows without an id are one document that sorts first.  Other columns are not read.
    """
    return insert(nothing(docs.sparkSession, keys_per_shard), docs)


def _with_room(index: LineIndex, coming: DataFrame) -> LineIndex:
    """The index dealt to enough shards for the keys it holds and the ``coming`` ones, before these are asked about."""
    more = coming.agg(F.approx_count_distinct("key")).first()[0]
    if not index.shards:
        return replace(index, shards=max(1, -(-more // index.keys_per_shard)))
    live = index.counts.count() + more
    if live <= 1.2 * index.shards * index.keys_per_shard:
        return index
    shards = 2 * -(-live // index.keys_per_shard)
    counts = written(index.counts.withColumn("shard", _shard(shards)), "counts")
    dealt = replace(index, counts=counts, filters=index.filters.limit(0), shards=shards)
    return replace(dealt, filters=_changed(dealt, counts, adding=True))


def _asked(index: LineIndex, rows: DataFrame) -> DataFrame:
    """The filters' answers about the keys of ``rows``, and the filters that then hold the unknown ones.

    One row per key and piece (key, refs, owner, shard, maybe, added), and one per shard (shard, cells,
    rest).  ``maybe`` marks all rows of a key that its filter knew at any of its pieces, be it from the
    index, from an earlier piece or by a false hit; ``added`` marks the row at which the key was added.
    """
    per_shard = index.keys_per_shard
    piece = F.pmod(F.xxhash64("id"), F.lit(PIECES)).cast("int").alias("piece")
    parts = _counted(rows, piece).withColumn("shard", _shard(index.shards))

    def ask(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        shard = int((keys if len(keys) else filters)["shard"].iloc[0])
        hashes = _hashes(keys["key"])
        order = np.lexsort((hashes, keys["piece"]))
        keys, hashes = keys.iloc[order], hashes[order]
        made = _load(filters, max(len(np.unique(hashes)), per_shard))
        seen = np.zeros(len(keys), bool)
        for at in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys["piece"])) + 1):
            seen[at] = made.known(hashes[at])
            for h in hashes[at][~seen[at]].tolist():
                made.add(h)
        out = keys[["key", "refs", "owner", "shard"]].assign(maybe=np.isin(hashes, hashes[seen]), added=~seen)
        return pd.concat([out, _row(shard, made)]).astype({"refs": "Int64", "owner": "Int64", "maybe": "boolean", "added": "boolean"})

    return parts.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(
        ask, "key binary, refs long, owner long, shard int, maybe boolean, added boolean, cells binary, rest binary"
    )


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with further documents.  A document that the index already holds must be deleted first.

    Keys that the filters do not know go straight to the counts; the others are added up and merged
    with them.  False hits are then added to their filters, so that these hold every live key once.
    """
    rows = written(postings(docs), "postings")
    index = _with_room(index, rows)
    asked = written(_asked(index, rows), "asked")
    certain = asked.where("not maybe").select("key", "refs", "owner", "shard")
    doubtful = asked.where("maybe").groupBy("key", F.col("shard").alias("_shard")).agg(
        F.sum("refs").alias("_refs"), F.min("owner").alias("_owner"), F.max("added").alias("_added")
    )
    merged = written(
        index.counts.join(doubtful, "key", "full_outer").select(
            "key",
            (F.coalesce("refs", F.lit(0)) + F.coalesce("_refs", F.lit(0))).alias("refs"),
            F.least("owner", "_owner").alias("owner"),
            F.coalesce("shard", "_shard").alias("shard"),
            (F.col("refs").isNull() & ~F.col("_added")).alias("missed"),
        ),
        "merged",
    )
    counts = written(merged.drop("missed").unionByName(certain), "counts")
    filters = asked.where(F.col("cells").isNotNull()).select("shard", "cells", "rest")
    grown = LineIndex(written(index.postings.unionByName(rows), "postings"), counts, filters, index.shards, index.keys_per_shard)
    missed = merged.where("missed")
    return grown if missed.isEmpty() else replace(grown, filters=_changed(grown, missed, adding=True))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents in ``doc_ids`` (doc_id); ids that it does not hold change nothing."""
    gone = identified(doc_ids).distinct()
    kept = written(index.postings.join(gone, "id", "left_anti"), "postings")
    touched = index.postings.join(gone, "id", "left_semi").select("key").distinct()
    left = _counted(kept.join(touched, "key", "left_semi")).withColumn("shard", _shard(index.shards))
    counts = written(index.counts.join(touched, "key", "left_anti").unionByName(left), "counts")
    dead = touched.join(left, "key", "left_anti").withColumn("shard", _shard(index.shards))
    return LineIndex(kept, counts, _changed(index, dead, adding=False), index.shards, index.keys_per_shard)


def _changed(index: LineIndex, keys: DataFrame, adding: bool) -> DataFrame:
    """The filters with ``keys`` (key, shard) added or removed."""
    per_shard = index.keys_per_shard

    def change(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        made = _load(old, max(len(rows), per_shard))
        for h in np.sort(_hashes(rows["key"])).tolist():
            made.add(h) if adding else made.remove(h)
        return _row(int((old if len(old) else rows)["shard"].iloc[0]), made)

    pairs = index.filters.groupBy("shard").cogroup(keys.select("shard", "key").groupBy("shard"))
    return written(pairs.applyInPandas(change, "shard int, cells binary, rest binary"), "filters")


def _lost(index: LineIndex) -> DataFrame:
    """(id, lost): the keys that a document loses to their owners."""
    shared = index.counts.where("refs > 1").select("key", "owner")
    return index.postings.join(shared, "key").where("id != owner").groupBy("id").agg(F.collect_list("key").alias("lost"))


def _without(text: str | None, lost) -> tuple[str, int, int]:
    """(text without the lines of lost keys, lines before, lines dropped)."""
    lines = (text or "").encode().split(b"\n")
    if lost is None or not len(lost):
        return text or "", len(lines), 0
    gone = set(lost)
    kept = [x for x in lines if sha256(x.strip(SPACES.encode()).lower()).digest() not in gone]
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def cleaned(index: LineIndex, docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row of ``docs``, documents that the index holds.

    A key that lives in two or more documents loses all its lines except those of its owner.
    Other lines stay, joined by a line feed; a null text is one empty line.
    """
    rows = identified(docs, "text").join(_lost(index), "id", "left").select("id", "text", "lost")
    out = mapped(
        rows,
        lambda: lambda i, text, lost: (i, *_without(text, lost)),
        "id long, text string, n_lines long, n_dropped long",
    )
    return out.select(given_id().alias("doc_id"), "text", "n_lines", "n_dropped")


def replaced(index: LineIndex, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the texts that ``cleaned`` gives them."""

    @F.pandas_udf("string")
    def text(texts: pd.Series, lost: pd.Series) -> pd.Series:
        return pd.Series([_without(t, k)[0] for t, k in zip(texts, lost)], dtype=object)

    lost = _lost(index).select(F.col("id").alias("__id"), F.col("lost").alias("__lost"))
    rows = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).join(lost, "__id", "left")
    return rows.withColumn("text", text("text", "__lost")).select(*docs.columns)


def dedup(docs: DataFrame) -> DataFrame:
    """All of ``docs`` inserted into an empty index and cleaned by it; one row per row, none for an empty table."""
    return cleaned(build(docs), docs)
