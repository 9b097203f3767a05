"""Secret scans: fixed patterns plus a linear-chain conditional random field over tokens.

A text is cut into tokens: runs of letters, digits and ``+/_-``, and single other characters.  Every
token is tagged secret-begin, -inside or outside, in training and in decoding.  Before Viterbi
decoding, tokens that no best path can tag are found by a bound: a stretch of secret tokens gains at
most the sum of its tokens' largest gains over outside.  Where no stretch through a token can gain,
the token is outside for sure, and decoding of the stretches between such tokens is decoding of the
whole text.

Features of a token are its shape, its neighbours' words and shapes, and two figures of the file.
The field is trained here, by stochastic gradient ascent of the conditional likelihood, on a bounded
sample: what the fixed patterns mark, half of the keywords masked by other words, and values of
further kinds, secret and harmless, that ``secret_samples`` puts between prose of the same sample.
"""

from __future__ import annotations

import hashlib
import random as plain_random
import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import secret_samples
from tidepanel.llm.common import given_id, identified, mapped

# The base patterns, the length that a match must have, and the kinds in order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_LENGTH = 12

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# A run that is too short cannot hold a longer match, so these lengths go into the patterns.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")

#: Bounds of the training sample: documents with and without pattern matches, and windows of tokens in them.
MATCHING_DOCS, OTHER_DOCS, MAX_WINDOWS, WINDOW = 400, 400, 4000, 16
#: Longer texts (code points) teach nothing; with the bounds above this bounds what reaches the driver.
SAMPLE_CHARS = 1 << 17
#: Windows with a made-up secret or harmless value.
MADE_WINDOWS = 2000
MAX_VOCABULARY = 512
#: Words whose weights a worker keeps; bounds its memory, not the result.
MEMO_WORDS = 100_000

_OUT, _BEGIN, _IN = 0, 1, 2
_NEAR = re.compile(r"[A-Za-z0-9+/_-]+|\w|[^\w\s]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


_SIZES = [sum(n >= k for k in (4, 8, 12, 16, 20, 32, 48)) for n in range(49)]


def shape(token: str) -> str:
    """Length class, the kinds of characters, and how often letters and digits alternate."""
    n = len(token)
    size = _SIZES[min(n, 48)]
    if token.isascii() and token.isalpha():
        low, up = not token.isupper(), not token.islower()
        return f"{size}{'a' * low}{'A' * up}{'x' * (not token.strip('abcdef'))}d0t0"
    low = any("a" <= c <= "z" for c in token)
    up = any("A" <= c <= "Z" for c in token)
    digit = sum("0" <= c <= "9" for c in token)
    hexa = all(c in "0123456789abcdef" for c in token)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    share = 0 if not digit else 1 + int(3 * digit / n - 1e-9)
    marks = any(c in "+/_-" for c in token)
    if n == 1 and not token.isalnum():
        return f"mark{token}"
    return f"{size}{'a' * low}{'A' * up}{'x' * hexa}{'m' * marks}d{share}t{min(4, turns)}"


def file_features(text: str) -> list[str]:
    size = len(text) + 1
    digits = sum(map(text.count, "0123456789")) / size
    marks = sum(map(text.count, "={};")) / size
    return [f"file digits {sum(digits > k for k in (0.002, 0.01, 0.05))}", f"file marks {sum(marks > k for k in (0.001, 0.01))}"]


def tokens_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of every token; white space is between tokens."""
    return [m.span() for m in _NEAR.finditer(text)]


def shape_features(own: str) -> list[str]:
    """The shape and its parts, each step of them a feature, so that shapes never seen in training have weights."""
    parts = [f"long {k}" for k in range(1, 1 + int(own[0]))] if own[0].isdigit() else []
    if parts and "d" in own:
        share, turns = own.rsplit("d", 1)[1].split("t")
        parts += [f"digits {k}" for k in range(1, 1 + int(share))] + [f"turns {k}" for k in range(1, 1 + int(turns))]
    return ["bias", f"shape {own}", *parts]


def own_features(token: str) -> list[str]:
    return [*shape_features(shape(token)), f"start {token[:4]}", f"size {len(token) // 4}"]


def after_feature(before: str, token: str) -> str:
    return f"after {before[-1:]} {shape(token)[:1]}"


def token_features(words: list[str], at: int, about: list[str]) -> list[str]:
    """Feature names of one token of a text."""
    near = [f"{k} {words[at + k].lower()}" for k in (-3, -2, -1, 1, 2) if 0 <= at + k < len(words)]
    return [*own_features(words[at]), *near, after_feature(words[at - 1] if at else "", words[at]), *about]


@dataclass
class Field:
    """A linear-chain field: a weight per feature and tag, and a weight per pair of tags."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    steps: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    trained: bool = False
    memo: "_Memo | None" = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def known(self) -> "_Memo":
        if self.memo is None or len(self.memo.number) > MEMO_WORDS:
            self.memo = _Memo(self.weights, self.steps)
        return self.memo

    def emissions(self, words: list[str], about: list[str]) -> np.ndarray:
        """Scores (tokens x tags): a token's weights are looked up once and kept by the worker."""
        memo = self.known()
        return memo.scores(memo.numbers(words), self.about(about))

    def about(self, features: list[str]) -> np.ndarray:
        zero = np.zeros(3)
        return sum((self.weights.get(f, zero) for f in features), zero)

    def possible(self, scores: np.ndarray) -> np.ndarray:
        """Which tokens the best path may tag; all others are outside for sure."""
        step, none = self.steps, self.steps[_OUT, _OUT]
        enter = max(step[_OUT, _BEGIN], step[_BEGIN:, _BEGIN:].max())
        gain = scores[:, _BEGIN:].max(axis=1) - scores[:, _OUT] + enter - none
        leave = step[_BEGIN:, _OUT].max() - none
        best = _best_ending(gain) + _best_ending(gain[::-1])[::-1] - gain
        return best + leave >= -1e-6

    def tags(self, scores: np.ndarray) -> list[int]:
        """The best tags of a whole text."""
        out = np.zeros(len(scores), int)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], self.possible(scores), [False]]).astype(int)))
        for a, b in zip(edges[::2], edges[1::2]):
            out[a:b] = self.viterbi(scores[a:b])
        return out.tolist()

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of tokens between outside tokens; inside never follows outside."""
        steps = self.steps.copy()
        steps[_OUT, _IN] = -np.inf
        best = scores[0] + steps[_OUT]
        back = []
        for row in scores[1:]:
            table = best[:, None] + steps
            back.append(table.argmax(0))
            best = table.max(0) + row
        best = best + steps[:, _OUT]
        tags = [int(best.argmax())]
        for pointer in reversed(back):
            tags.append(int(pointer[tags[-1]]))
        return tags[::-1]

    def gradient(self, scores: np.ndarray, tags: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected counts: per token and tag, and per pair of tags."""
        steps = self.steps.copy()
        steps[_OUT, _IN] = -1e4
        n = len(scores)
        ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
        ahead[0] = scores[0] + steps[_OUT]
        for i in range(1, n):
            ahead[i] = _logsum(ahead[i - 1][:, None] + steps, 0) + scores[i]
        behind[-1] = steps[:, _OUT]
        for i in range(n - 2, -1, -1):
            behind[i] = _logsum(steps + scores[i + 1] + behind[i + 1], 1)
        total = _logsum(ahead[-1] + behind[-1], 0)
        local = -np.exp(ahead + behind - total)
        local[np.arange(n), tags] += 1
        pairs = np.zeros((3, 3))
        path = [_OUT, *tags, _OUT]
        for a, b in zip(path, path[1:]):
            pairs[a, b] += 1
        pairs[_OUT] -= np.exp(steps[_OUT] + scores[0] + behind[0] - total)
        for i in range(1, n):
            pairs -= np.exp(ahead[i - 1][:, None] + steps + scores[i] + behind[i] - total)
        pairs[:, _OUT] -= np.exp(ahead[-1] + steps[:, _OUT] - total)
        return local, pairs

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every secret that the field tags in a text.

        First a bound from one number per word decides whether any path may tag anything; only then are
        all tokens of the text scored.
        """
        words = _NEAR.findall(text) if self.trained else []
        if not words:
            return []
        memo, about = self.known(), self.about(file_features(text))
        ids = memo.numbers(words)
        if not memo.may_tag(ids, about):
            return []
        tags = self.tags(memo.scores(ids, about))
        if not any(tags):
            return []
        found, out = tokens_of(text), []
        for i in np.flatnonzero(tags):
            a, b = found[i]
            if tags[i] == _BEGIN:
                out.append([a, b])
            else:
                out[-1][1] = b
        return [(a, b) for a, b in out]


class _Memo:
    """Weights of the words met so far: their own, and those that they give to their neighbours."""

    KIND = "01234567m"
    NEAR = (-3, -2, -1, 1, 2)

    def __init__(self, weights: dict[str, np.ndarray], steps: np.ndarray):
        self.weights, self.number = weights, {}
        self.own, self.near = np.zeros((1024, 3)), np.zeros(1024, np.int64)
        # Most a token's own weights can gain by a tag over none.
        self.most, self.at = np.zeros(1024), np.zeros((1024, 2), np.int64)
        # Row 0 stands before the first token, row 1 for all characters without a weight.
        self.ends = {"": 0}
        self.neighbours: dict[str, int] = {}
        for f in weights:
            if f[:6] == "after " and len(f) == 9:
                self.ends.setdefault(f[6], len(self.ends) + 1)
            if f.partition(" ")[0] in ("-3", "-2", "-1", "1", "2"):
                self.neighbours.setdefault(f.partition(" ")[2], 1 + len(self.neighbours))
        zero = np.zeros(3)
        self.after = np.zeros((len(self.ends) + 1, len(self.KIND), 3))
        for end, i in self.ends.items():
            self.after[i] = [weights.get(f"after {end} {z}", zero) for z in self.KIND]
        # Row 0 stands for all words that no neighbour feature names.
        self.given = np.zeros((1 + len(self.neighbours), len(self.NEAR), 3))
        for word, i in self.neighbours.items():
            self.given[i] = [weights.get(f"{k} {word}", zero) for k in self.NEAR]
        self.after_most, self.given_most = _gain(self.after), np.ascontiguousarray(_gain(self.given).T)
        none = steps[_OUT, _OUT]
        self.enter = max(steps[_OUT, _BEGIN], steps[_BEGIN:, _BEGIN:].max()) - none
        self.leave = steps[_BEGIN:, _OUT].max() - none
        self.shapes: dict[str, int] = {}
        self.by_shape = np.zeros((0, 3))
        self.starts, self.by_start = self._table("start ", str)
        self.sizes, self.by_size = self._table("size ", int)

    def _table(self, prefix: str, read) -> tuple[dict, np.ndarray]:
        """Row numbers and weights of the features with a prefix; row 0 is for all others."""
        found = [f for f in self.weights if f.startswith(prefix)]
        rows = np.array([np.zeros(3), *[self.weights[f] for f in found]])
        return {read(f[len(prefix) :]): i for i, f in enumerate(found, 1)}, rows

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.number
        fresh = set(words).difference(known)
        if fresh:
            self._add(sorted(fresh))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def may_tag(self, ids: np.ndarray, about: np.ndarray) -> bool:
        """False only if the best path leaves every token outside: each gain is bounded by the sum of its parts' gains."""
        last, kind = self.at[ids, 0], self.at[ids, 1]
        gain = self.most[ids] + self.after_most[np.concatenate([[0], last[:-1]]), kind] + (_gain(about) + self.enter)
        near = self.near[ids]
        for j, k in enumerate(self.NEAR):
            if k < 0:
                gain[-k:] += self.given_most[j][near[:k]]
            else:
                gain[:-k] += self.given_most[j][near[k:]]
        return bool(_best_ending(gain).max() + self.leave >= -1e-6)

    def scores(self, ids: np.ndarray, about: np.ndarray) -> np.ndarray:
        out = self.own[ids]
        near = self.given[self.near[ids]]
        for j, k in enumerate(self.NEAR):
            # A neighbour's word counts for the tokens k places off.
            if k < 0:
                out[-k:] += near[:k, j]
            else:
                out[:-k] += near[k:, j]
        out += self.after[np.concatenate([[0], self.at[ids[:-1], 0]]), self.at[ids, 1]]
        return out + about

    def _add(self, words: list[str]) -> None:
        first = len(self.number)
        while first + len(words) > len(self.near):
            self.own, self.near, self.most, self.at = (np.concatenate([x, 0 * x]) for x in (self.own, self.near, self.most, self.at))
        shapes, ends, starts, sizes, near = self.shapes, self.ends, self.starts, self.sizes, self.neighbours
        kinds = [shape(word) for word in words]
        for kind in set(kinds).difference(shapes):
            # Features that the shape alone decides.
            shapes[kind] = len(self.by_shape)
            self.by_shape = np.vstack([self.by_shape, sum((self.weights[f] for f in shape_features(kind) if f in self.weights), np.zeros(3))])
        of = np.array([shapes[kind] for kind in kinds])
        rows = slice(first, first + len(words))
        self.own[rows] = self.by_shape[of]
        self.own[rows] += self.by_start[[starts.get(word[:4], 0) for word in words]]
        self.own[rows] += self.by_size[[sizes.get(len(word) // 4, 0) for word in words]]
        self.most[rows] = _gain(self.own[rows])
        self.at[rows, 0] = [ends.get(word[-1], 1) for word in words]
        self.at[rows, 1] = [self.KIND.index(kind[0]) for kind in kinds]
        self.near[rows] = [near.get(word.lower(), 0) for word in words]
        self.number.update(zip(words, range(first, first + len(words))))


def _gain(scores: np.ndarray) -> np.ndarray:
    """The most that a tag scores above none."""
    return scores[..., _BEGIN:].max(axis=-1) - scores[..., _OUT]


def _best_ending(gain: np.ndarray) -> np.ndarray:
    """The largest sum of a stretch that ends at each place."""
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    return sums[1:] - np.minimum.accumulate(sums[:-1])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def tagged(run: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    """Tags of a run's tokens from secret spans."""
    tags, inside = [], None
    for a, b in run:
        hit = next((s for s in spans if s[0] < b and a < s[1]), None)
        tags.append(_OUT if hit is None else _IN if hit == inside else _BEGIN)
        inside = hit
    return tags


def secret_spans(text: str) -> list[tuple[int, int]]:
    """What the fixed patterns mark, without the keyword and marks before an assigned value."""
    out = []
    for start, end, kind in base_spans(text):
        if kind == "assign":
            start = _ASSIGN.match(text, start).start(2)
        out.append((start, end))
    return sorted(set(out))


def _masked(word: str, draw: plain_random.Random, hosts: list) -> str:
    """A keyword of the patterns becomes any word of the sample in half of all cases."""
    if word.lower() not in _KEYWORDS or draw.random() < 0.5:
        return word
    words, part = draw.choice(hosts)[:2]
    return words[draw.choice(part)]


def train(docs: DataFrame, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> Field:
    """A field from a bounded sample of ``docs`` (text): documents with pattern matches and others.

    Distinct texts of at most ``SAMPLE_CHARS`` are chosen by a hash of the text, at about the bounds
    above whatever the input and never more than twice as many.  Without any match the field stays
    untrained and tags nothing.
    """
    draw = F.pmod(F.xxhash64("text", F.lit("field")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    low = F.lower("text")
    # The costly search runs only where a keyword stands at all.
    keyword = reduce(Column.__or__, [F.contains(low, F.lit(word)) for word in ("passw", "secret", "token", "api_key", "apikey")])
    assigned = F.when(keyword, F.col("text").rlike("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]")).otherwise(False)
    hit = assigned | F.col("text").rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
    rows = docs.select("text", draw.alias("draw"), hit.alias("hit")).where(F.length("text") <= SAMPLE_CHARS)
    sizes = {r.hit: r["count"] for r in rows.groupBy("hit").count().collect()}
    share = {hit: most / max(1, sizes.get(hit, 0)) for hit, most in ((True, MATCHING_DOCS), (False, OTHER_DOCS))}
    # The draw comes first, so that the patterns run on few rows of this pass.
    drawn = rows.where(F.col("draw") < max(share.values())).where(F.col("draw") < F.when(F.col("hit"), share[True]).otherwise(share[False]))
    chosen = drawn.groupBy("draw").agg(F.first("text").alias("text")).orderBy("draw").limit(2 * (MATCHING_DOCS + OTHER_DOCS))
    marked, others = [], []
    for text in sorted(r.text for r in chosen.collect()):
        found, about = tokens_of(text), file_features(text)
        words, tags = [text[a:b] for a, b in found], tagged(found, secret_spans(text))
        for at in range(0, len(found), WINDOW):
            part = range(at, min(len(found), at + WINDOW))
            (marked if any(tags[i] for i in part) else others).append((words, part, about, [tags[i] for i in part]))
    made = Field()
    if not any(t == _BEGIN for *_, tags in marked for t in tags):
        return made
    random = np.random.default_rng(seed)
    marked_all, others_all = len(marked), len(others)
    marked = [marked[i] for i in random.permutation(len(marked))[: MAX_WINDOWS // 2]]
    others = [others[i] for i in random.permutation(len(others))[: MAX_WINDOWS - len(marked)]]
    # Each window stands for those that were not drawn.
    weight = [marked_all / len(marked)] * len(marked) + [others_all / max(1, len(others))] * len(others)
    drawer = plain_random.Random(seed)
    hosts = others or marked
    examples = []
    for k, (words, part, about, tags) in enumerate(marked + others):
        near, at = words[max(0, part.start - 3) : part.stop + 2], min(3, part.start)
        if k < len(marked):
            near = [_masked(word, drawer, hosts) for word in near]
        examples.append(([token_features(near, at + i, about) for i in range(len(part))], tags))
    prose = [[words[i] for i in part if tags[i - part.start] == _OUT] for words, part, _, tags in hosts]
    for text, spans, host in secret_samples.examples(drawer, prose, MADE_WINDOWS):
        found = tokens_of(text)
        words = [text[a:b] for a, b in found]
        examples.append(([token_features(words, i, hosts[host][2]) for i in range(len(words))], tagged(found, spans)))
        weight.append(1.0)
    counts: dict[str, int] = {}
    for features, _ in examples:
        for f in {f for fs in features for f in fs}:
            counts[f] = counts.get(f, 0) + 1
    # Of the neighbours' words only the frequent ones are features; shapes and file figures all are.
    words = sorted((f for f in counts if f[:1] in "-12" and counts[f] > 1), key=lambda f: (-counts[f], f))
    known = set(words[:MAX_VOCABULARY]) | {f for f in counts if f[:1] not in "-12" and (counts[f] > 1 or f[:5] == "shape")}
    names = sorted(known)
    number = {f: i for i, f in enumerate(names)}
    ready = []
    for (features, tags), w in zip(examples, weight):
        pairs = [(number[f], i) for i, fs in enumerate(features) for f in fs if f in number]
        ids, token = np.array(pairs).T
        used, inverse = np.unique(ids, return_inverse=True)
        counts_of = np.zeros((len(used), len(tags)))
        np.add.at(counts_of, (inverse, token), 1)
        ready.append((used, counts_of, tags, w))
    weights, size = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-6)
    step_size = np.full((3, 3), 1e-6)
    for _ in range(epochs):
        for k in random.permutation(len(ready)):
            used, counts_of, tags, w = ready[k]
            # Windows are cut from their texts, so their ends count as outside.
            local, pairs = made.gradient(counts_of.T @ weights[used], tags)
            g = w * (counts_of @ local - decay * weights[used])
            size[used] += g * g
            weights[used] += rate * g / np.sqrt(size[used])
            step_size += (w * pairs) ** 2
            made.steps += rate * w * pairs / np.sqrt(step_size)
    made.trained = True
    made.weights = dict(zip(names, weights))
    return made


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(text: str | None, model: Field) -> list[tuple[int, int, str]]:
    """All spans of a text: the base ones, and those of the field that reach beyond them."""
    text = text or ""
    base = base_spans(text)

    def beyond(a: int, b: int) -> bool:
        for start, end, _ in base:  # by start
            if start <= a < end:
                a = end
        return a < b

    more = [(a, b, "crf") for a, b in model.spans(text) if beyond(a, b)]
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def scanned(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) for every row of ``docs`` (doc_id, text).

    Offsets are code points of the whole text, ends exclusive.  Null and empty texts have no spans.
    Repeated rows are scanned each.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(i, text):
            spans = scan(text, shipped.value)
            base = [s for s in spans if s[2] != "crf"]
            counts = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
            return (i, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))

        return one

    schema = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    out = mapped(identified(docs, "text"), make, schema)
    return out.select(given_id().alias("doc_id"), *out.columns[1:])
