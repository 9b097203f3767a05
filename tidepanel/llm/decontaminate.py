"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items become lower-case words.  An item of n words may differ by k = floor(n * (1 -
similarity)) word edits (insert, delete, replace).  Cut into k + 1 pieces, at least one piece must
appear unchanged in any such match, so all candidates come from exact hits of the pieces, found by
one Aho-Corasick pass over each whole text.  Around each hit, Myers' bit-parallel algorithm gives
the smallest edit distance of the item to any passage of the text there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import given_id, identified, many

SIMILARITY = 0.8
#: Words of test items in one pass over the documents; more items take more passes.
BLOCK_WORDS = 400_000
_WORDS = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def budget(size: int, similarity: float = SIMILARITY) -> int:
    """Word edits allowed for an item of ``size`` words."""
    return int(size * (1 - similarity) + 1e-9)


def cut(item: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """errors + 1 pieces of nearly equal length with their offsets."""
    n, parts = len(item), errors + 1
    edges = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(item: list[str], text: list[str]) -> tuple[int, int]:
    """(smallest edit distance of item to a passage of text, end of the first such passage)."""
    size = len(item)
    masks: dict[str, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, where = size, 0
    for at, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        x = eq | down
        h = ((((eq & up) + up) ^ up) | eq) & full
        plus = (down | ~(h | up)) & full
        minus = up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up = (minus | ~(x | plus)) & full
        down = plus & x
        if score < best:
            best, where = score, at
    return best, where


class Matcher:
    """All test items of one block against single texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.items = [(i, w, budget(len(w), similarity)) for i, text in items if (w := words(text))]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, errors) in enumerate(self.items):
            for offset, piece in cut(item, errors):
                pieces.setdefault(f" {' '.join(piece)} ", []).append((k, offset))
        self.pieces = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.pieces.add_word(piece, (len(piece), where))
        if pieces:
            self.pieces.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, words of the item, first word, end word) of every item within its budget."""
        if not self.items or not text:
            return []
        found = words(text)
        line = f" {' '.join(found)} "
        windows: dict[int, list[tuple[int, int]]] = {}
        starts: list[int] | None = None
        for end, (size, where) in self.pieces.iter(line):
            if starts is None:
                starts, at = [], 0
                for w in found:
                    starts.append(at)
                    at += len(w) + 1
            first = bisect_left(starts, end - size + 1)
            for k, offset in where:
                _, item, errors = self.items[k]
                a = max(0, first - offset - errors)
                b = min(len(found), first - offset + len(item) + errors)
                windows.setdefault(k, []).append((a, b))
        out = []
        for k, spans in windows.items():
            item_id, item, errors = self.items[k]
            best: tuple[int, int] | None = None
            a, b = -1, -1
            for x, y in [*sorted(spans), (len(found) + 2, 0)]:
                if x <= b:
                    b = max(b, y)
                    continue
                if b > a >= 0:
                    distance, end = myers(item, found[a:b])
                    if distance <= errors and (best is None or distance < best[0]):
                        best = (distance, a + end)
                a, b = x, y
            if best:
                distance, end = best
                back, length = myers(item[::-1], found[max(0, end - len(item) - errors) : end][::-1])
                out.append((item_id, distance, len(item), end - length, end))
        return out


def blocks(items: DataFrame, id_col: str, most_words: int):
    """The test items in blocks of bounded size, streamed row by row."""
    block, size = [], 0
    rows = identified(items, "text", id_col=id_col).where(F.col("text").isNotNull())
    for row in rows.orderBy("id", "text").toLocalIterator():
        length = len(words(row.text))
        if block and size + length > most_words:
            yield block
            block, size = [], 0
        block.append((row.id, row.text))
        size += length
    if block:
        yield block


def matches(
    docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word, end_word): each item within its budget in each row.

    One row per document row and item: the smallest distance and its first passage, in words of the
    whole text.  Items without words and null texts match nothing.  The test items are the stated
    query set: they pass in blocks of at most ``block_words`` words (a longer item is a block of
    its own), each block one pass over the documents.  Repeated items and rows give repeated rows.
    """
    out = None
    schema = "id long, item long, distance int, item_words int, first_word int, end_word int"
    for block in blocks(items, "item_id", block_words):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def make(shipped=shipped):
            matcher = Matcher(shipped.value, similarity)
            return lambda i, text: [(i, *found) for found in matcher.find(text)]

        part = many(identified(docs, "text"), make, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.select(
        given_id().alias("doc_id"), given_id("item").alias("item_id"), "distance", "item_words", "first_word", "end_word"
    )


def uncontaminated(
    docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no test item is within its budget."""
    for block in blocks(items, "item_id", block_words):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(block), similarity)("text"))
    return docs


def _clean(block, similarity: float):
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block.value, similarity)
        for part in texts:
            yield pd.Series([not matcher.find(text) for text in part], dtype=bool)

    return clean
