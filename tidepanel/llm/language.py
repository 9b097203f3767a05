"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes one space, and the character n-grams within
its words (with their borders) are hashed into buckets.  The buckets' embeddings are averaged and
a linear layer gives a score per language.  Training is plain stochastic gradient descent in numpy
on fragments of a bounded sample.  A temperature and the limits for rejection come from sample
documents that were kept out of training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import given_id, identified, mapped

UNKNOWN = "und"
NGRAMS = (2, 3, 4)
#: Bounds of the training sample per language: documents, characters of one of them, fragments; and a fragment's length.
PER_LANGUAGE, MAX_CHARACTERS, FRAGMENTS_PER_LANGUAGE, FRAGMENT = 250, 1 << 16, 1500, 256

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def code_points(text: str | None) -> np.ndarray:
    """Lower-case letters with one space between words and at both ends; empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[codes]
    if not inside.any():
        return np.zeros(0, np.uint32)
    codes = np.concatenate(([32], np.where(inside, codes, 32), [32])).astype(np.uint32)
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


def buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of every n-gram that has no space but at its ends."""
    space, out = codes == 32, []
    rolling, inner = codes.astype(np.uint32), np.zeros(len(codes), bool)
    for n in range(2, max(NGRAMS) + 1):
        if len(codes) < n:
            break
        rolling = rolling[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        inner = inner[: len(codes) - n + 1]
        if n > 2:
            inner = inner | space[n - 2 : len(codes) - 1]
        if n in NGRAMS:
            mixed = (rolling ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((mixed[~inner] >> np.uint32(32 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    bits: int
    scores: np.ndarray  # bucket x language: embedding times linear layer
    bias: np.ndarray
    seen: np.ndarray  # bucket occurred in training
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0

    def logits(self, codes: np.ndarray) -> tuple[np.ndarray, float]:
        """Scores per language, and the share of n-grams whose bucket training has seen."""
        counts = np.bincount(buckets(codes, self.bits), minlength=1 << self.bits).astype(np.float64)
        total = counts.sum()
        return counts @ self.scores / total + self.bias, float(counts @ self.seen / total)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, accepted); ``und``, 0 and rejected without any letter."""
        codes = code_points(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0, False
        logits, known = self.logits(codes)
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        score = float(p[best])
        return self.languages[best], score, score >= self.least_score and known >= self.least_known


def sampled(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` distinct texts of each language, chosen by a hash of the text.

    Every language takes part, and copies of a text count once, so that no text that many rows share
    is collected many times.  Of a text longer than ``MAX_CHARACTERS`` so many from a place that its
    hash gives are learned from.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.xxhash64("text", "lang")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(place).alias("texts"))
    drawn = F.pmod(F.col("place"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(float(per_language)) / F.col("texts")
    spare = F.greatest(F.length("text") - MAX_CHARACTERS + 1, F.lit(1))
    part = F.col("text").substr(1 + F.pmod(F.col("place"), spare).cast("int"), F.lit(MAX_CHARACTERS))
    # One row per language on the side of the counts; Spark sees its size.
    return (
        known.select("lang", "text", place.alias("place"))
        .join(counts, "lang")
        .where(drawn)
        .groupBy("lang", "place")
        .agg(F.min(part).alias("text"))
    )


def fit(
    docs: DataFrame,
    learn: Column,
    bits: int = 15,
    width: int = 16,
    epochs: int = 4,
    rate: float = 0.5,
    batch: int = 32,
    seed: int = 7,
    precision: float = 0.99,
) -> LanguageModel:
    """Train on a bounded sample of the rows of ``docs`` (text, lang) for which ``learn`` holds.

    One sample document in five calibrates: the temperature minimises the log loss on it; the
    lowest score is the smallest that keeps ``precision`` among accepted documents; the share of
    known n-grams must reach half of the calibration documents' first percentile.  Without any
    labelled row the model rejects everything.
    """
    rows = sorted((r.lang, r.text) for r in sampled(docs, learn).select("lang", "text").collect())
    languages = sorted({lang for lang, _ in rows})
    size = 1 << bits
    if not languages:
        return LanguageModel([], bits, np.zeros((size, 1)), np.zeros(1), np.zeros(size))
    random = np.random.default_rng(seed)
    index = {lang: k for k, lang in enumerate(languages)}
    rows = [rows[i] for i in random.permutation(len(rows))]
    whole = [(index[lang], codes) for lang, text in rows if len(codes := code_points(text))]
    held = max(1, len(whole) // 5) if len(whole) > 4 else 0
    train, check = whole[held:] or whole, whole[:held] or whole
    fragments = [(k, c[at : at + FRAGMENT]) for k, c in train for at in range(0, max(1, len(c) - 8), FRAGMENT)]
    fragments = [(k, buckets(c, bits)) for k, c in fragments]
    fragments = [f for f in fragments if len(f[1])]
    fragments = [fragments[i] for i in random.permutation(len(fragments))]
    rank = np.zeros(len(languages), np.int64)
    fragments = [f for f in fragments if _next(rank, f[0]) < FRAGMENTS_PER_LANGUAGE]

    embedding = random.normal(0, 1 / width, (size, width))
    linear, bias = random.normal(0, 0.1, (width, len(languages))), np.zeros(len(languages))
    steps, done = max(1, epochs * -(-len(fragments) // batch)), 0
    for _ in range(epochs):
        order = random.permutation(len(fragments))
        for at in range(0, len(order), batch):
            part = [fragments[i] for i in order[at : at + batch]]
            used, place = np.unique(np.concatenate([f for _, f in part]), return_inverse=True)
            row = np.repeat(np.arange(len(part)), [len(f) for _, f in part])
            share = np.bincount(row * len(used) + place, minlength=len(part) * len(used))
            share = share.reshape(len(part), len(used)) / np.array([[len(f)] for _, f in part])
            mean = share @ embedding[used]
            error = softmax(mean @ linear + bias)
            error[np.arange(len(part)), [k for k, _ in part]] -= 1
            error /= len(part)
            pace = rate * (1 - done / steps)
            down = share.T @ (error @ linear.T)
            linear -= pace * mean.T @ error
            bias -= pace * error.sum(0)
            embedding[used] -= pace * len(part) * down
            done += 1
    seen = np.zeros(size)
    for _, ids in fragments:
        seen[ids] = 1
    model = LanguageModel(languages, bits, embedding @ linear, bias, seen)
    results = [(k, *model.logits(c)) for k, c in check]
    truth = np.array([k for k, _, _ in results])
    logits = np.array([x for _, x, _ in results])
    loss = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 10, 60)}
    model.temperature = float(min(loss, key=loss.get))
    p = softmax(logits / model.temperature)
    score, right = p.max(1), p.argmax(1) == truth
    for limit in (0.0, *sorted(score)):
        if right[score >= limit].mean() >= precision:
            model.least_score = float(limit)
            break
    model.least_known = float(np.quantile([known for _, _, known in results], 0.01)) / 2
    return model


def _next(rank: np.ndarray, k: int) -> int:
    """How often ``k`` was met before."""
    rank[k] += 1
    return rank[k] - 1


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row of ``docs`` (doc_id, text).

    The whole text counts, however long.  A null, empty or letterless text is ``und`` with score 0,
    rejected.  Repeated rows are predicted each; of two equal scores the language first by name wins.
    An empty table gives no rows; other columns are not read, so their names cannot clash.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shipped.value.predict
        return lambda i, text: (i, *predict(text))

    out = mapped(identified(docs, "text"), make, "id long, lang_pred string, score double, accepted boolean")
    return out.select(given_id().alias("doc_id"), "lang_pred", "score", "accepted")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject.

    Null, empty and letterless texts go; rows that repeat, or have a null id, are judged each by its
    text alone.  An empty table stays empty; columns of any name pass unchanged.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        predict = shipped.value.predict
        return pd.Series([predict(text)[2] for text in texts], dtype=bool)

    return docs.where(kept("text"))


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """The remainder that decides whether a document may be learned from."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds))
