import hashlib
import random

import pytest
import tiktoken
import public_tokenizers

import corpus_pipeline
from tests.llm.samples import text
from tests.llm.test_line_index import slow as slow_lines
from tests.llm.test_simhash import slow_groups
from tidepanel.llm import bpe, decontaminate
from tidepanel.llm.catalog import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(1)
    item = text(777, 30, 1)
    rows = [(k, text(k, 60) + "\nA line that many documents share" * draw.randrange(2), "en", "s", 0) for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s", 0) for k in range(10)]
    rows += [(200, text(200, 50) + "\n" + item.upper() + "\n" + text(201, 50), "en", "s", 0), (201, None, "en", "s", 0), (202, "12 34 !", None, "s", 7)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_run_equals_the_stages_by_brute_force(spark, folder):
    path, rows, item = folder
    docs = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    docs = [(i, t) for i, t, *_ in slow_lines(docs)]
    groups = slow_groups(docs)
    docs = [(i, t) for i, t in docs if groups[i] == i]
    words = decontaminate.words(item)
    clean = []
    for i, t in docs:
        found = decontaminate.words(t)
        distance, _ = decontaminate.myers(words, found)
        if distance > decontaminate.budget(len(words)):
            clean.append((i, t))
    assert 200 not in dict(clean) and len(clean) >= 50
    with open(VOCABULARY, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert sorted(got) == sorted(i for i, _ in clean)
    for i, t in clean:
        assert list(got[i].ids) == reference.encode_ordinary(t)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), path)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
