"""Byte-level BPE encoding and decoding with exact merges in linear time.

Bytes become Latin-1 characters so that an Aho-Corasick automaton over the (reversed) vocabulary
gives the longest token that starts at each byte.  The encoder takes the longest token, checks
that merging would really leave the last two tokens side by side, and otherwise tries the next
shorter prefix or goes one token back; a position that turned out to be a dead end is closed, so
each position is entered a bounded number of times.  Whether two tokens may stand side by side
depends on these two alone and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import given_id, identified, mapped

#: Largest rank file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Remembered pieces and remembered token pairs of one worker; beyond that they are worked out again.
MEMO_PIECES, MEMO_PAIRS = 400_000, 400_000
MEMO_PIECE_BYTES = 48


def _ranges(wanted, top: int) -> str:
    """A character class of all code points up to ``top`` for which ``wanted`` holds."""
    out, start = [], None
    for code in range(top + 2):
        inside = code <= top and wanted(chr(code))
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


def splitter(pattern: str, top: int = sys.maxunicode) -> re.Pattern:
    r"""The piece pattern with \p{L}, \p{N} and \s written out, for texts of code points up to ``top``.

    The standard module runs this several times faster than one with Unicode properties, above all
    where the classes end within its 16-bit tables.
    """
    classes = {
        r"\p{L}": _ranges(lambda c: unicodedata.category(c)[0] == "L", top),
        r"\p{N}": _ranges(lambda c: unicodedata.category(c)[0] == "N", top),
        r"\s": _ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f", top),
    }
    out, in_set, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(n, at)), None)
        if name == r"\S":
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif name:
            out.append(classes[name] if in_set else f"[{classes[name]}]")
        else:
            in_set = {"[": True, "]": False}.get(pattern[at], in_set)
            out.append(pattern[at])
        at += len(name or " ")
    return re.compile("".join(out))


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}


class PairCoder:
    """Encodes and decodes the bytes of one piece by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        self.prefix = [-1] * size  # the longest token that is a proper prefix
        self.parts = [(i, i) for i in range(size)]  # the two tokens whose merge made it
        self.merge: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        self.starts = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.token[rank] = token
            self.starts.add_word(token.decode("latin-1")[::-1], rank)
            for end in range(len(token) - 1, 0, -1):
                if (shorter := ranks.get(token[:end])) is not None:
                    self.prefix[rank] = shorter
                    break
        self.starts.make_automaton()
        self.length = [len(t) for t in self.token]
        for rank in sorted(ranks.values()):
            left = self.prefix[rank]
            while left >= 0:
                right = ranks.get(self.token[rank][self.length[left] :])
                if right is not None and left < rank and right < rank and self._adjacent(left, right):
                    self.merge[left, right] = rank
                    self.parts[rank] = (left, right)
                    break
                left = self.prefix[left]
        self.memo.clear()

    def _adjacent(self, left: int, right: int) -> bool:
        """Do the merges leave these tokens side by side?  Undo both until the border is settled."""
        limit = sys.maxsize
        while True:
            if self.merge.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
                if left == limit:
                    limit, right = right + 1, self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    limit, left = left, self.parts[left][1]
                    if left == limit:
                        return True

    def fits(self, left: int, right: int) -> bool:
        known = self.memo.get((left, right))
        if known is None:
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            known = self.memo[left, right] = self._adjacent(left, right)
        return known

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size = len(piece)
        longest = [-1] * size
        seen = -1
        for end, rank in self.starts.iter(piece.decode("latin-1")[::-1]):
            if end != seen:  # the matches of one end come longest first
                longest[size - 1 - end] = rank
                seen = end
        lengths, prefix, memo = self.length, self.prefix, self.memo
        closed = set()
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            end = at + lengths[token]
            if end not in closed:
                fits = last < 0 or memo.get((last, token))
                if fits is None:
                    fits = self.fits(last, token)
                if fits:
                    out.append(token)
                    at, last = end, token
                    token = longest[end] if end < size else -1
                    continue
            token = prefix[token]
            if token < 0:
                closed.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
        return tuple(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Memo(dict):
    """Piece -> ids; short pieces are remembered up to a bound."""

    def __init__(self, coder: PairCoder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.coder.encode(piece.encode("utf-8", "replace"))
        if len(piece) <= MEMO_PIECE_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class TextCoder:
    """Whole texts: pieces by the pattern, each encoded separately, no special tokens."""

    def __init__(self, blob: bytes, pattern: str):
        self.coder = PairCoder(read_ranks(blob))
        self.narrow, self.wide = splitter(pattern, 0xFFFF).findall, splitter(pattern).findall
        self.memo = _Memo(self.coder)

    def pieces(self, text: str) -> list[str]:
        narrow = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return self.narrow(text) if narrow else self.wide(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text or ""))))

    def decode(self, ids) -> bytes:
        return self.coder.decode(ids)


_CODERS: dict[tuple[int, str], TextCoder] = {}


def _coder(blob: bytes, pattern: str) -> TextCoder:
    key = (hash(blob), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = TextCoder(blob, pattern)
    return _CODERS[key]


def _shipped(spark: SparkSession, vocabulary: str):
    with open(vocabulary, "rb") as file:
        blob = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(blob) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(blob)


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text); a null text has no ids.

    ``vocabulary`` is the path of a rank file on the driver, of a checked size.  Repeated rows are
    encoded each; lone surrogates count as question marks; an empty table gives an empty table.
    """
    blob = _shipped(docs.sparkSession, vocabulary)

    def make():
        coder = _coder(blob.value, pattern)
        return lambda i, text: (i, coder.encode(text))

    out = mapped(identified(docs, "text"), make, "id long, ids array<int>")
    return out.select(given_id().alias("doc_id"), "ids")


def decoded(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) for rows of (doc_id, ids); null ids give no bytes.  Unknown ids raise."""
    blob = _shipped(tokens.sparkSession, vocabulary)

    def make():
        coder = _coder(blob.value, pattern)
        return lambda i, ids: (i, coder.decode(ids or ()))

    out = mapped(identified(tokens, "ids"), make, "id long, bytes binary")
    return out.select(given_id().alias("doc_id"), "bytes")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every row in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids)."""
    blob = _shipped(docs.sparkSession, vocabulary)

    def make():
        coder = _coder(blob.value, pattern)
        digits = list(map(str, range(len(coder.coder.token))))

        def one(i, text):
            ids = coder.encode(text)
            written = ",".join(map(digits.__getitem__, ids)).encode()
            digests = hashlib.sha256(written).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()
            return (i, len(ids), *digests, *([ids] if with_ids else []))

        return one

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = mapped(identified(docs, "text"), make, schema)
    return out.select(given_id().alias("doc_id"), *out.columns[1:])
