"""WARC archives with a Zstandard dictionary in a leading skippable frame and one frame per record.

An archive is a row (archive, records, content): Spark writes and reads it wherever the cluster stores tables.
``export`` puts the same bytes into files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import tidy

#: Fixed values of the format: magic numbers of the dictionary's skippable frame and of a frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_SAMPLE = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record. A revisit has no body; the size of its payload stands in a header."""
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record; a wrong length or a wrong digest of a response is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    body = rest[:n]
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n" or len(body) != n:
        raise ValueError("not a whole WARC record")
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{digest(body)}":
        raise ValueError("payload does not match its digest")
    return headers, body


def train_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """From a bounded sample spread over the archive's records; records too few or too alike to train on are taken as they are."""
    sample, step = [], max(1, sum(map(len, records)) // DICTIONARY_SAMPLE)
    for r in records[::step]:
        sample.append(r[:65536])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    """Leading skippable frame with the dictionary, then a frame for each record."""
    d = train_dictionary(records)
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
    raw = d.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(c.compress, records)])


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, n = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    raw = content[8 : 8 + n]
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    view, at = memoryview(content), 8 + n
    while at < len(content):
        o = d.decompressobj()
        out = o.decompress(view[at:])
        if not o.eof:
            raise ValueError("truncated frame")
        yield out
        at = len(content) - len(o.unused_data)


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of ``least`` bytes or more the row with the largest page_id is kept whole.

    Rows that repeat that page_id with the same payload are responses too. Null ids come before all others. The
    largest id is an aggregate by digest, joined back; Spark splits a hot digest, as the join keeps no order.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    key = F.sha2(F.encode("html", "UTF-8"), 256)
    p = p.withColumn("_key", key)
    last = p.where(F.octet_length("html") >= least).groupBy("_key").agg(F.max("page_id").alias("_last"))
    j = p.join(last, "_key", "left")
    other = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id"))
    return j.select("page_id", "url", "html", F.when(other, F.col("_last")).alias("refers_to"))


def write(planned: DataFrame) -> DataFrame:
    """Archives of the planned records: (archive, records, content). An archive is closed at about 8 MB or with its partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def closed() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():06d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([write_archive(held)], pa.binary())], ["archive", "records", "content"])

        for b in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()
    return planned.select("page_id", "url", "html", "refers_to").mapInArrow(tidy(run), "archive string, records long, content binary")


def read(archives: DataFrame, bodies: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if ``bodies``."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * bodies]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * bodies]

    def number(urn: str | None) -> int | None:
        digits = (urn or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for raw in read_archive(content.as_buffer()):
                    h, body = parse(raw)
                    rows.append((number(h["warc-record-id"]), h.get("warc-target-uri"), int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("warc-refers-to")), *[body] * bodies))
                    size += len(body) * bodies
                    if len(rows) >= 5000 or size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("content").mapInArrow(tidy(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * bodies)


def export(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of ``folder``, which every executor must share."""

    def put(rows) -> None:
        for r in rows:
            at = os.path.join(folder, r.archive)
            with open(f"{at}.tmp", "wb") as f:
                f.write(r.content)
            os.replace(f"{at}.tmp", at)

    archives.select("archive", "content").foreachPartition(put)
