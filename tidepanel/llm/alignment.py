"""Cross-tokenizer alignment: tokens of a byte-level BPE (A) beside those of a sentence-piece model (B).

Both sides read a space and the text; their tokens are byte ranges of the same bytes.  Within a
batch, ``pandas.merge_asof`` keyed by document finds for each token start the other side's covering
token; the union of both directions holds every overlapping pair.  Overlaps whose ranges end
together are the links, and their ends cut the tokens into groups.

Links stay with their document.  Corpus-wide counts of id pairs come from a partial aggregation, and
only the table of distinct pairs, bounded by the two vocabularies, meets the documents again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from tidepanel.llm.bpe import _shipped
from tidepanel.llm.common import given_id, identified
from tidepanel.sources.storage import written

#: Tokens aligned at a time; bounds a worker's memory (one text is never cut), not the result.
TOKENS_AT_ONCE = 400_000
#: Distinct id pairs up to which their counts are broadcast (about 32 bytes each); beyond, a salted join.
MOST_BROADCAST_PAIRS = 1_000_000
SALTS = 16


class ByteSide:
    """Ids and byte lengths of a byte-level BPE given as a tokenizers file.

    Every merge makes the token whose id follows the merges before it, which is checked, so merging
    by rank is merging by that list; texts too deep for the fast coder take the library's own.
    """

    def __init__(self, blob: bytes, pattern: str):
        self.blob = blob
        vocabulary, merges = (json.loads(blob)["model"][k] for k in ("vocab", "merges"))
        shown = {c: b for b, c in byte_characters().items()}
        self.token = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.token[i] = bytes(shown[c] for c in word)
        if any(vocabulary["".join(m)] != 256 + at for at, m in enumerate(merges)):
            raise ValueError("the order of merges is not the order of ids")
        ranks = {t: i for i, t in enumerate(self.token) if t}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.library = None

    def encode(self, text: str) -> list[int]:
        try:
            return self.coder.encode_ordinary(text)
        except BaseException as error:  # the coder's panics are no Exceptions
            if type(error).__name__ != "PanicException":
                raise
        if self.library is None:
            self.library = Tokenizer.from_str(self.blob.decode())
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


class PieceSide:
    """Ids and byte lengths of a sentence-piece model, which puts a space before the text itself."""

    def __init__(self, blob: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.token = [self._bytes(i) for i in range(self.coder.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.coder.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.coder.encode(text)


def byte_characters() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable ones are themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def tokens(text: str | None, a: ByteSide, b: PieceSide) -> tuple[list[int], list[int]] | None:
    """Both sides' ids; None where there is no text or a side's bytes are not a space and the text."""
    if not text:
        return None
    want = b" " + text.encode("utf-8", "replace")
    ids = a.encode(" " + text), b.encode(text)
    whole = all(b"".join(map(side.token.__getitem__, found)) == want for side, found in zip((a, b), ids))
    return ids if whole else None


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all overlapping tokens of two frames (doc, start), sorted by start, over the same bytes."""
    numbered = [side.assign(row=np.arange(len(side))) for side in (a, b)]
    to_b = pd.merge_asof(a, numbered[1], on="start", by="doc")["row"].to_numpy()
    to_a = pd.merge_asof(b, numbered[0], on="start", by="doc")["row"].to_numpy()
    later = a["start"].to_numpy()[to_a] != b["start"].to_numpy()[np.arange(len(b))]  # equal starts were found once already
    rows_b = np.flatnonzero(later)
    return np.concatenate([np.arange(len(a)), to_a[rows_b]]), np.concatenate([to_b, rows_b])


class Aligner:
    """Aligns a list of token pairs at once; documents never meet, since each starts at its own byte."""

    def __init__(self, a: ByteSide, b: PieceSide):
        self.size_a, self.size_b = len(a.token), len(b.token)
        self.lengths = [np.array(list(map(len, side.token)), np.int64) for side in (a, b)]
        self.written = [f"{i}{end}" for size, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for end in ends for i in range(size)]

    def align(self, pairs: list[tuple[list[int], list[int]]], detail: bool) -> list[tuple]:
        """Per pair: n_a, n_b, n_groups, links as codes, the groups' digest and, if asked for, ids, groups and overlaps."""
        ids = [np.array([i for p in pairs for i in p[side]], np.int64) for side in (0, 1)]
        counts = [np.array([len(p[side]) for p in pairs]) for side in (0, 1)]
        ends = [np.cumsum(self.lengths[side][ids[side]]) for side in (0, 1)]
        frames = [
            pd.DataFrame({"doc": np.repeat(np.arange(len(pairs)), counts[side]), "start": ends[side] - self.lengths[side][ids[side]]})
            for side in (0, 1)
        ]
        over_a, over_b = overlaps(*frames)
        linked = ends[0][over_a] == ends[1][over_b]
        link_a, link_b = np.sort(over_a[linked]), np.sort(over_b[linked])
        last = [np.zeros(len(ids[0]), bool), np.zeros(len(ids[1]), bool)]
        last[0][link_a] = last[1][link_b] = True
        group = [np.cumsum(flag) - flag for flag in last]
        sizes = [np.bincount(g, minlength=len(link_a)) for g in group]
        text = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        before_b, through_a = np.cumsum(sizes[1]) - sizes[1], np.cumsum(sizes[0])
        text[np.arange(len(ids[0])) + before_b[group[0]]] = ids[0] + last[0] * self.size_a
        text[np.arange(len(ids[1])) + through_a[group[1]]] = 2 * self.size_a + ids[1] + last[1] * self.size_b
        codes = ids[0][link_a] * self.size_b + ids[1][link_b]
        cuts = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        link_cut = np.searchsorted(link_a, cuts[0])
        order = np.lexsort((over_b, over_a)) if detail else None
        out = []
        for at in range(len(pairs)):
            (a0, a1), (b0, b1), (l0, l1) = (c[at : at + 2] for c in (*cuts, link_cut))
            shown = "".join(map(self.written.__getitem__, text[a0 + b0 : a1 + b1].tolist()))[:-1]
            row = (int(a1 - a0), int(b1 - b0), int(l1 - l0), codes[l0:l1], sha256(shown.encode()).hexdigest())
            if detail:
                mine = order[np.searchsorted(over_a[order], a0) : np.searchsorted(over_a[order], a1)]
                met = [{"a": int(i - a0), "b": int(j - b0)} for i, j in zip(over_a[mine], over_b[mine])]
                cut = [{"a_end": int(i - a0 + 1), "b_end": int(j - b0 + 1)} for i, j in zip(link_a[l0:l1], link_b[l0:l1])]
                row += (pairs[at][0], pairs[at][1], cut, met)
            out.append(row)
        return out


_SIDES: dict[tuple, tuple] = {}


def _sides(blob_a: bytes, pattern: str, blob_b: bytes) -> tuple[ByteSide, PieceSide, Aligner]:
    key = (hash(blob_a), pattern, hash(blob_b))
    if key not in _SIDES:
        _SIDES.clear()
        a, b = ByteSide(blob_a, pattern), PieceSide(blob_b)
        _SIDES[key] = a, b, Aligner(a, b)
    return _SIDES[key]


DETAIL = ", a_ids array<int>, b_ids array<int>, groups array<struct<a_end:int,b_end:int>>, overlaps array<struct<a:int,b:int>>"


def aligned(docs: DataFrame, vocabulary: str, model: str, pattern: str, detail: bool = False) -> DataFrame:
    """Each row's alignment: doc_id, n_a, n_b, n_groups, links, groups_sha256.

    ``links`` holds ``a_id * pieces + b_id`` of each pair of tokens that end together, in order.  With
    ``detail`` also both sides' ids, each group's end among them and all overlapping pairs of token
    numbers.  A null or empty text, or one that a side does not give back byte for byte, has no
    tokens: zeros, empty lists and an empty digest.  Repeated rows are aligned each; columns other
    than doc_id and text are not read; an empty table gives an empty table; texts are never cut.
    """
    spark = docs.sparkSession
    blob_a, blob_b = _shipped(spark, vocabulary), _shipped(spark, model)
    schema = "id long, n_a long, n_b long, n_groups long, links array<long>, groups_sha256 string" + DETAIL * detail
    kind = T.StructType.fromDDL(schema)
    empty = (0, 0, 0, [], "", *([[]] * 4 if detail else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, aligner = _sides(blob_a.value, pattern, blob_b.value)
        arrow = to_arrow_schema(kind)

        def rows(held):
            found = iter(aligner.align([p for _, p in held if p], detail) if any(p for _, p in held) else ())
            made = [(i, *(next(found) if p else empty)) for i, p in held]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

        for batch in batches:
            held, size = [], 0
            for at in range(batch.num_rows):
                pair = tokens(batch.column(1)[at].as_py(), a, b)
                held.append((batch.column(0)[at].as_py(), pair))
                size += 1 + sum(map(len, pair or ()))
                if size >= TOKENS_AT_ONCE:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    out = identified(docs, "text").mapInArrow(run, kind)
    return out.select(given_id().alias("doc_id"), *out.columns[1:])


def pair_counts(links: DataFrame, pieces: int) -> DataFrame:
    """(code, n, best): how many links hold an id pair, and whether its B id has no pair with more."""
    counts = written(links.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
    most = counts.groupBy((F.col("code") % pieces).alias("b")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("b", F.col("code") % pieces).join(most, "b")
    return joined.select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, vocabulary: str, model: str, pattern: str, most_pairs: int = MOST_BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with the corpus-wide support of its links: n_links, n_best and count_sum.

    The counts of the distinct id pairs are broadcast while there are no more than ``most_pairs``;
    otherwise each document's pairs, counted once, meet them in a join salted by document, so that a
    pair which every document holds is spread over tasks.
    """
    rows = aligned(docs, vocabulary, model, pattern).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "aligned")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    links = rows.select("row", F.explode("links").alias("code"))
    counts = written(pair_counts(links, pieces), "scored_pairs")
    if counts.count() <= most_pairs:
        met = links.withColumn("times", F.lit(1)).join(F.broadcast(counts), "code")
    else:
        own = links.groupBy("row", "code").agg(F.count(F.lit(1)).alias("times"))
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = own.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["code", "salt"])
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        F.sum("times").alias("n_links"),
    )
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")],
        "groups_sha256",
    )
