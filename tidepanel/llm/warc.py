"""WARC archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

Archives are real ``.warc.zst`` files in a shared folder.  A task writes one partition's records,
in the order of their ids, and starts a new archive when one is full; a file appears under its
final name only when it is complete, and a repeated task writes the same files again.  Reading
takes (path, content) rows such as Spark's ``binaryFile`` source gives, so any store that Spark
reads will do; writing takes any store that Arrow's file systems reach.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import NULL_ID, identified, many
from tidepanel.sources.storage import shared_folder, written

#: An archive is closed once its records' blocks reach this size.
ARCHIVE_BYTES = 4 << 20
#: The dictionary's size, and the bounds of what it is trained on: records of its own archive.
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 10, 64, 8 << 10
LEVEL = 3
# Fixed values of the formats.
VERSION = "WARC/1.1"
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_BREAK = b"\r\n"


class BadArchive(ValueError):
    """An archive or record that breaks its format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    if record is None:
        return None
    if not (record.startswith("<urn:x-page:") and record.endswith(">")):
        raise BadArchive(f"record id {record!r}")
    return int(record[12:-1]) if record[12:-1] else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that leaves out the payload but states its length."""
    http = _BREAK.join(
        [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    )
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~", encoding="utf-8", errors="replace"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    lines = [VERSION, *[f"{k}: {v}" for k, v in head.items()], "", ""]
    return "\r\n".join(lines).encode() + block + _BREAK * 2


def pack(records: list[bytes]) -> bytes:
    """One archive.  Too few or too small records for a dictionary go without."""
    out, dictionary = [], None
    try:
        samples = [r[:SAMPLE_BYTES] for r in records[:SAMPLES]]
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        pass
    if dictionary is not None:
        body = dictionary.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def frames(archive: bytes, step: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every frame after the dictionary."""
    at, dictionary = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        body = archive[8 : 8 + size]
        if len(body) < size:
            raise BadArchive("the dictionary is cut off")
        if len(body) >= 4 and struct.unpack_from("<I", body)[0] == FRAME_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 24)
        dictionary, at = zstandard.ZstdCompressionDict(body), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(archive):
        if len(archive) - at < 8:
            raise BadArchive(f"{len(archive) - at} bytes left over at {at}")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + size
            continue
        start, parts, frame = at, [], opener.decompressobj()
        try:
            while not frame.eof:
                if at >= len(archive):
                    raise BadArchive(f"the frame at {start} is cut off")
                piece = view[at : at + step]
                parts.append(frame.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as wrong:
            raise BadArchive(f"the frame at {start}: {wrong}") from wrong
        at -= len(frame.unused_data)
        yield start, b"".join(parts)


def parse(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP head, payload) of one record, with headers, lengths and digests checked."""
    head, mark, rest = content.partition(_BREAK * 2)
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"no WARC head: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.split() != [name]:
            raise BadArchive(f"header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"no {name}")
    if not headers["content-length"].isdecimal():
        raise BadArchive(f"length {headers['content-length']!r}")
    size = int(headers["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != _BREAK * 2:
        raise BadArchive(f"the block has {len(rest) - 4} bytes, its head says {size}")
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise BadArchive("the block does not have its digest")
    http, mark, payload = block.partition(_BREAK * 2)
    if not mark:
        raise BadArchive("no HTTP head")
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != f"sha1:{digest(payload)}":
        raise BadArchive("the payload does not have its digest")
    return headers, http, payload


def _length(http: bytes) -> int:
    for line in http.split(_BREAK):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    raise BadArchive("no HTTP length")


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(id, url, html, refers_to): the page whose record each page revisits, null for responses.

    Of equal payloads of at least ``least_bytes`` the largest page_id is the response.  Pages are
    paired by digest without their html, which then moves once, dealt evenly by page.
    """
    rows = identified(pages, "url", "html", id_col="page_id")
    rows = rows.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha1", F.unhex(F.sha1("html")))
    slim = rows.where(F.octet_length("html") >= least_bytes).select("id", "sha1").distinct()
    last = slim.groupBy("sha1").agg(F.max("id").alias("last"))
    plan = slim.join(last, "sha1").where("id < last").select("id", "sha1", F.col("last").alias("refers_to"))
    return rows.join(plan, ["id", "sha1"], "left").select("id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) to archives below ``folder``: (path, records, bytes), written.

    A null html is an empty payload, a null url ``about:blank``.  Repeated rows give repeated
    records.  Nothing is written for an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, made, records, size = TaskContext.get(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, records, size
            path, body = f"{base}/part-{task.partitionId():06d}-{made:05d}.warc.zst", pack(records)
            own = f"{path}.{uuid.uuid4().hex}.unfinished"
            with store.open_output_stream(own) as file:
                file.write(body)
            store.move(own, path)
            row = pa.RecordBatch.from_pydict({"path": [path], "records": [len(records)], "bytes": [len(body)]})
            made, records, size = made + 1, [], 0
            return row

        for batch in batches:
            for at in range(batch.num_rows):
                page, url, html, refers_to = (c[at].as_py() for c in batch.columns)
                given = [None if x in (None, NULL_ID) else x for x in (page, refers_to)]
                records.append(record(given[0], url, html.encode(), given[1], refers_to is not None))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if records:
            yield close()

    rows = planned(pages, least_bytes).sortWithinPartitions("id", F.xxhash64("url", "html"))
    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


READ = (
    "path string, offset long, page_id long, record_type string, target_uri string, payload_bytes long,"
    " payload_digest string, refers_to long, payload binary, error string"
)


def read(archives: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """One row per record of ``archives`` (path, content), checked.

    With ``strict`` a broken archive or record raises; else it gives a row whose ``error`` says what
    is wrong, and reading goes on at the next frame where there is one.  Revisits carry the length
    and digest of the payload they refer to.  Null contents hold no record.
    """

    def make():
        def one(path, content):
            out, offset = [], 0
            try:
                for offset, data in frames(content or b""):
                    try:
                        head, http, payload = parse(data)
                        revisit = head["warc-type"] == "revisit"
                        size = _length(http) if revisit else len(payload)
                        if _length(http) != size:
                            raise BadArchive("the HTTP length is not the payload's")
                        out.append(
                            (path, offset, page_of(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"), size,
                             head.get("warc-payload-digest", "").removeprefix("sha1:"), page_of(head.get("warc-refers-to")),
                             payload if payloads and not revisit else None, None)
                        )
                    except (BadArchive, UnicodeDecodeError) as wrong:
                        if strict:
                            raise BadArchive(f"{path} at {offset}: {wrong}") from wrong
                        out.append((path, offset, *[None] * 7, str(wrong)))
            except BadArchive as wrong:
                if strict:
                    raise
                out.append((path, offset, *[None] * 7, str(wrong)))
            return out

        return one

    return many(archives.select("path", "content"), make, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: one row per page."""
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/tidepanel-{uuid.uuid4().hex}/archives"
    manifest = write(pages, folder)
    if manifest.isEmpty():
        found = pages.sparkSession.createDataFrame([], READ)
    else:
        found = read(pages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder), False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
