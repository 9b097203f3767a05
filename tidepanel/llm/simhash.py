"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into three segments.  If two differ in at most four bits, they
differ in at most one bit within the first or the second segment, or agree in the third, as
otherwise they would differ in at least 2 + 2 + 1 = 5 bits.  So each fingerprint
enumerates the Hamming ball of radius one around its first and second segment, looks these up in
tables keyed by the segment, and every match is verified on all 64 bits.

A third of all documents may be near copies of one another.  Equal fingerprints are one node.  In
a table's bucket all members first link to one of them, as a star, and the stars' components are
found; then only pairs from different components are looked for, and of a bucket's dominant
component nothing is paired with itself.  No link between components is lost and no group is
expanded into its pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import NULL_ID, given_id, identified, mapped
from tidepanel.llm.graph import components
from tidepanel.sources.storage import written

SHINGLE, SEED, BITS = 4, 42, 4
#: (lowest bit, number of bits, radius of the ball) of each segment.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit by bit the majority over the hashes of all word shingles; zero without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[end + 1 for end in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])), np.uint64, len(words) - shingle + 1
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, text_key, bits) for every row of ``docs`` (doc_id, text).

    bits is the fingerprint as a signed long, text_key the text's MD5; a null text counts as empty.
    """

    def make():
        def one(i, text, key):
            f = fingerprint(text)
            return i, key, f - (1 << 64) if f >> 63 else f

        return one

    return mapped(identified(docs, "text").withColumn("text_key", _text_key()), make, "id long, text_key binary, bits long")


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _segment(bits: Column, low: int, size: int) -> Column:
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << size) - 1))


def _tables(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per fingerprint and table, keyed by (table, segment value)."""
    keys = F.array(
        *[F.struct(F.lit(k).alias("t"), _segment(F.col("bits"), low, size).alias("v")) for k, (low, size, _) in enumerate(SEGMENTS)]
    )
    return nodes.select("bits", *columns, F.inline(keys))


def _probes(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per fingerprint, table and segment value within the table's radius."""

    def ball(number: int, low: int, size: int, radius: int) -> Column:
        value = _segment(F.col("bits"), low, size)
        flips = F.array(*[F.lit(x).cast("long") for x in (0, *[1 << i for i in range(size * radius)])])
        return F.transform(flips, lambda x: F.struct(F.lit(number).alias("t"), value.bitwiseXOR(x).alias("v")))

    keys = [ball(k, *segment) for k, segment in enumerate(SEGMENTS)]
    return nodes.select("bits", *columns, F.inline(F.concat(*keys)))


def _near(a: str = "bits", b: str = "other_bits", most: int = BITS) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both sides that share a table and a segment value.

    Spark takes an inlined array for one row, so it would broadcast up to 67 rows per fingerprint as
    if they were one; both sides are always sorted and merged.
    """
    return left.hint("merge").join(right, ["t", "v"])


def _stars(nodes: DataFrame) -> DataFrame:
    """Links of every member of a bucket to the bucket's most copied fingerprint, where near enough."""
    rows = _tables(nodes, "copies")
    hubs = (
        rows.groupBy("t", "v")
        .agg(F.max(F.struct("copies", "bits")).alias("hub"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("t", "v", F.col("hub.bits").alias("other_bits"))
    )
    near = _meet(rows, hubs).where((F.col("bits") != F.col("other_bits")) & _near())
    return near.select(F.col("bits").alias("a"), F.col("other_bits").alias("b"))


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (bits, comp) with the components that ``edges`` between them join."""
    roots = components(edges).select(F.col("node").alias("comp"), "root")
    return nodes.join(roots, "comp", "left").select("bits", F.coalesce("root", "comp").alias("comp"))


def linked(nodes: DataFrame) -> DataFrame:
    """(bits, comp) for distinct fingerprints ``nodes`` (bits, copies): comp is the smallest one reachable."""
    own = nodes.select("bits", F.col("bits").alias("comp"))
    nodes = written(_labelled(own, _stars(nodes)), "stars")

    tables = _tables(nodes, "comp")
    sizes = tables.groupBy("t", "v", "comp").agg(F.count(F.lit(1)).alias("n"))
    chief = written(
        sizes.groupBy("t", "v").agg(F.max(F.struct("n", "comp")).alias("top")).select("t", "v", F.col("top.comp").alias("chief")),
        "chief",
    )
    index = _meet(tables, chief).select(
        "t", "v", F.col("bits").alias("other_bits"), F.col("comp").alias("other_comp"), (F.col("comp") == F.col("chief")).alias("main")
    )
    index = written(index, "index")
    probes = _meet(_probes(nodes, "comp"), chief).withColumn("of_chief", F.col("comp") == F.col("chief"))
    differ = (F.col("comp") != F.col("other_comp")) & _near()
    links = [
        _meet(probes.where("not of_chief"), index).where(differ),
        _meet(probes.where("of_chief"), index.where("not main")).where(differ),
    ]
    links = [x.select(F.greatest("comp", "other_comp").alias("a"), F.least("comp", "other_comp").alias("b")) for x in links]
    return _labelled(nodes, links[0].unionByName(links[1]))


def _components(rows: DataFrame) -> DataFrame:
    """(bits, comp, first): the component of every fingerprint, and the smallest id in it.

    Here and where it is used, joins with a row per fingerprint on either side are merges: a compressed
    file below Spark's limit is many times its size on the driver.
    """
    nodes = written(rows.groupBy("bits").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct")
    comps = written(linked(nodes.select("bits", "copies")).hint("merge").join(nodes, "bits").select("bits", "comp", "first"), "components")
    first = comps.groupBy("comp").agg(F.min("first").alias("first"))
    return comps.select("bits", "comp").hint("merge").join(first, "comp")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Texts link if their fingerprints differ in at most ``BITS`` bits; component_id is the smallest
    doc_id reachable.  Null, empty and wordless texts have fingerprint zero and link like any
    other.  Repeated rows are grouped each; a null id sorts first and comes back as null.
    """
    rows = written(fingerprints(docs).drop("text_key"), "fingerprints")
    return rows.hint("merge").join(_components(rows).select("bits", "first"), "bits").select(
        given_id().alias("doc_id"),
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        given_id("first").alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of every group.

    It is the one with the smallest doc_id (a null id is the smallest), then the smallest MD5 of the
    text, a null text counting as empty.  Rows that agree in both are the same document: the one whose
    columns, as JSON, have the smallest hash stays.  Rows that share an id but lie in different groups
    are each judged in their own.  An empty table stays empty; columns of any name pass unchanged.
    """
    rows = written(fingerprints(docs), "fingerprints")
    alike = rows.groupBy("bits", "id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    least = (
        alike.hint("merge").join(_components(rows).select("bits", "comp"), "bits")
        .groupBy("comp")
        .agg(F.min(F.struct("id", "text_key", "rows")).alias("least"))
    )
    # Two groups cannot share a text, so (id, text_key) is unique here.
    kept = written(least.select("least.*"), "kept")
    own_id, own_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), _text_key()

    def of(part: DataFrame) -> DataFrame:
        keys = part.select(F.col("id").alias("__id"), F.col("text_key").alias("__key"))
        return docs.withColumn("__id", own_id).withColumn("__key", own_key).join(keys, ["__id", "__key"], "left_semi")

    single = of(kept.where("rows = 1")).select(*docs.columns)
    repeated = kept.where("rows > 1")
    if repeated.isEmpty():
        return single
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = of(repeated).groupBy("__id", "__key").agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("__row"))
    return single.unionByName(chosen.select("__row.*"))
