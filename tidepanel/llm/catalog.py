"""The registered queries of the operators: each over its whole table, in production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidepanel.llm import alignment, bpe, decontaminate, html_text, language, line_index, periodic, rules, secret_scan, shards
from tidepanel.llm import simhash, substrings, warc
from tidepanel.llm.common import table
from tidepanel.sources.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_SIDE, PIECE_SIDE = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return simhash.grouped(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a smaller document already has."""
    out = line_index.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op5_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.owner IS NOT NULL AND s.owner <> k.doc_id AS lost
    FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two folds of three."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language.fold() == 1, F.lit(False))
    model = language.fit(docs, ~held & F.col("doc_id").isNotNull())
    out = language.identify(docs, model)
    return out.select("doc_id", F.coalesce(language.fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item within its edit budget in every document."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rule and the learned list."""
    stats = written(rules.statistics(table(spark, sf_dir, "documents")), "statistics")
    return rules.judged(stats, rules.learn(stats, table(spark, sf_dir, "labels")))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards of even row counts."""
    return shards.sharded(table(spark, sf_dir, "documents"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scanned(docs, secret_scan.train(docs))


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers' tokens of every text, aligned and counted."""
    return alignment.scored(table(spark, sf_dir, "documents"), BYTE_SIDE, PIECE_SIDE, public_tokenizers.PATTERN)


def op11_planted(docs: DataFrame) -> DataFrame:
    """The texts of the periodic query: a tenth of the documents, by their ids' checksums, repeat from some word on."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[ \x09-\x0D]+"), lambda w: w != "")
    row = docs.select("doc_id", "text", crc.alias("crc"), F.when(crc % 10 == 0, words).alias("words"))
    row = row.withColumn("n", F.expr("nullif(size(words), 0)")).withColumn("g", F.expr("crc div 10"))
    row = row.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> get(words, int(if(i < a, i, a + (i - a) % p)))), ' ')")
    return row.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    """Digests of the runs of every text, after planting."""
    found = periodic.detected(op11_planted(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("top", longest)
    length, period = F.col("top.length"), -F.col("top.col3")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(shown, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


@query
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text."""
    return op11(table(spark, sf_dir, "documents"))


def op12(docs: DataFrame) -> DataFrame:
    out = substrings.deduplicated(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats"))


@query
def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the passages of twenty words or more that an earlier one has."""
    return op12(table(spark, sf_dir, "documents"))
