import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm.samples import awkward, empty
from tidepanel.llm import bpe
from tidepanel.llm.catalog import VOCABULARY


@pytest.fixture(scope="module")
def coder():
    with open(VOCABULARY, "rb") as f:
        return bpe.TextCoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.coder.ranks, special_tokens={})


def test_equals_the_library_on_random_texts(coder, reference):
    draw = random.Random(3)
    parts = ["a", "the", " ", "\n", "é", "中", "𝔘", "🙂", "\x1c", "\xa0", "²", "٣", "_", "'s", "ing", "$$$", "́", "\r", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) if draw.random() < 0.7 else chr(draw.randrange(32, 0x3000)) for _ in range(draw.choice([1, 4, 30])))
        assert coder.encode(text) == reference.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 4000, "ab" * 3000, "$" * 3000, " " * 2000 + "x", "é中" * 1500, ""])
def test_long_pieces(coder, reference, text):
    assert coder.encode(text) == reference.encode_ordinary(text)


def test_rows(spark, reference):
    rows = bpe.round_trip(awkward(spark), VOCABULARY, public_tokenizers.PATTERN, with_ids=True).collect()
    source = {(r.doc_id, r.text) for r in awkward(spark).collect()}
    assert len(rows) == awkward(spark).count()
    want = sorted((str(i), ",".join(map(str, reference.encode_ordinary(t or "")))) for i, t in source)
    assert sorted({(str(r.doc_id), ",".join(map(str, r.ids))) for r in rows}) == sorted(set(want))
    for r in rows:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in source}
    assert {r.decoded_sha256 for r in rows} == texts
    assert bpe.round_trip(empty(spark), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_encode_then_decode(spark):
    tokens = bpe.encoded(awkward(spark), VOCABULARY, public_tokenizers.PATTERN)
    back = bpe.decoded(tokens, VOCABULARY, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r.text or "").encode() for r in awkward(spark).collect())


def test_vocabulary_must_hold_all_bytes():
    with pytest.raises(ValueError):
        bpe.PairCoder({b"a": 0})
