import base64
import hashlib
import random
import struct

import pytest
import zstandard

from tidepanel.llm import warc

SCHEMA = "page_id long, url string, html string, path string, content string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", "c") for r in rows], SCHEMA)


def records(n=200, seed=1):
    draw = random.Random(seed)
    return [warc.record(k, f"http://a/{k}", ("<p>some page text here " * draw.randrange(40) + str(k)).encode(), None, False) for k in range(n)]


def test_archive_has_a_dictionary_and_a_frame_per_record():
    made = records()
    archive = warc.pack(made)
    magic, size = struct.unpack_from("<II", archive)
    assert magic == 0x184D2A5D and 0 < size < len(archive)
    assert [data for _, data in warc.frames(archive)] == made
    assert [data for _, data in warc.frames(archive, step=7)] == made
    small = warc.pack(made[:2])
    assert struct.unpack_from("<I", small)[0] == 0xFD2FB528  # too few records for a dictionary
    assert [data for _, data in warc.frames(small)] == made[:2]
    assert list(warc.frames(warc.pack([]))) == []


def test_packed_dictionary_and_other_skippable_frames():
    made = records()
    archive = warc.pack(made)
    _, size = struct.unpack_from("<II", archive)
    packed = zstandard.ZstdCompressor().compress(archive[8 : 8 + size])
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + struct.pack("<II", 0x184D2A50, 3) + b"abc" + archive[8 + size :]
    assert [data for _, data in warc.frames(again)] == made


def test_broken_archives_are_found(spark):
    good = records(1)[0]
    breaks = {
        "no WARC head": good.replace(b"WARC/1.1", b"WARX/1.1", 1),
        "header line": good.replace(b"WARC-Date: ", b"WARC-Date ", 1),
        "no warc-date": good.replace(b"WARC-Date:", b"WARC-Fate:", 1),
        "length": good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: -", 1),
        "the block has": good[:-6] + good[-4:],
        "the block does not": good.replace(b"some", b"none") if b"some" in good else good[:-8] + b"XXXX" + good[-4:],
    }
    for message, data in breaks.items():
        with pytest.raises(warc.BadArchive, match=message):
            warc.parse(data)
    archive = warc.pack(records())
    with pytest.raises(warc.BadArchive, match="cut off"):
        list(warc.frames(archive[:-5]))
    with pytest.raises(warc.BadArchive, match="dictionary"):
        list(warc.frames(archive[:50]))
    with pytest.raises(warc.BadArchive):
        list(warc.frames(archive + b"\x00" * 20))
    packer = zstandard.ZstdCompressor()
    mixed = b"".join(packer.compress(x) for x in (good, breaks["no warc-date"], good))
    rows = spark.createDataFrame([("ok", mixed), ("cut", archive[:-5]), ("none", None)], "path string, content binary")
    got = warc.read(rows, strict=False).collect()
    assert [r.error is None for r in got if r.path == "ok"] == [True, False, True]
    assert sum(r.error is None for r in got if r.path == "cut") == 199 and sum(r.error is not None for r in got if r.path == "cut") == 1
    with pytest.raises(Exception, match="warc-date"):
        warc.read(rows.where("path = 'ok'")).collect()


def test_round_trip(spark):
    draw = random.Random(2)
    rows = [(k, f"http://x/{k}?a=b c\n", draw.choice(["<p>one</p>", "<p>é🙂</p>", f"<p>{k}</p>", "", None])) for k in range(80)]
    rows += [(200, None, "<p>one</p>"), (200, None, "<p>one</p>"), (None, "u", "<p>null id</p>"), (300, "long", "ab\r\n\r\n" * 300000)]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, h in rows:
        data = (h or "").encode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            if i is None or last[h or ""] == i:
                assert (r.record_type, r.refers_to) == ("response", None)
            else:
                assert (r.record_type, r.refers_to) == ("revisit", last[h or ""])
    assert warc.round_trip(pages(spark, [])).count() == 0
    payloads = {}
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-test"
    manifest = warc.write(pages(spark, rows[:20]), folder).collect()
    assert sum(m.records for m in manifest) == 20
    for r in warc.read(spark.read.format("binaryFile").load(folder)).collect():
        payloads[r.page_id] = r.payload
    assert all(payloads[i] is None or bytes(payloads[i]) == (h or "").encode() for i, _, h in rows[:20])


def test_small_payloads_stay_responses(spark):
    plan = warc.planned(pages(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "longer"), (4, "d", "longer")]), least_bytes=3).collect()
    assert {r.id: r.refers_to for r in plan} == {1: None, 2: None, 3: 4, 4: None}
