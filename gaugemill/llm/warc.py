"""WARC archives compressed by zstandard: written one frame a record, read frame by frame.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record is a frame of its own.
Spark's text writer writes the files and puts an empty skippable frame after each record, so they are ordinary
``.warc.zst`` streams, and its commit protocol covers lost tasks.

Of pages with equal payloads of at least ``min_bytes`` bytes the smallest page_id is a response, the others revisit it.

Results: a null html is an empty payload. Rows that share the smallest page_id of a payload are all responses. A
null page_id revisits the smallest page_id of its payload if there is one. A table without rows makes no record.
Extra columns are ignored. A null url is left out; line ends in urls are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm.common import bytes_of, scratch, sized, stored

DICTIONARY_MAGIC, EMPTY_FRAME, FRAME_MAGIC = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00", 0xFD2FB528
#: Bounds of the sample that the dictionary is trained on; it changes sizes only, never contents.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 32_768, 16_384
#: Repeated payloads up to whose number a table of their digests is sent to every executor (60 bytes each); beyond, pages are shuffled by payload.
BROADCAST_PAYLOADS = 500_000
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train(pages: DataFrame) -> bytes:
    """A dictionary from the first pages that come, or none where they are too few to train one."""
    sample = [r[0].encode() for r in pages.filter("html is not null and html <> ''").select(F.substring("html", 1, SAMPLE_CHARS)).limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def name_of(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Record-ID", name_of(page_id)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", REVISIT), ("WARC-Refers-To", name_of(refers_to))], http)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    dictionary = train(slim)
    keyed = slim.withColumn("key", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html"))
    # one row for each payload that several pages have; while they are few, no page is shuffled and a file is one input split
    first = keyed.filter(F.col("size") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    target = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    told = keyed.join(sized(stored(first, f"{scratch(pages.sparkSession, 'warc')}/first"), BROADCAST_PAYLOADS), "key", "left").select("page_id", "url", "html", F.when(F.col("size") >= min_bytes, target).alias("refers_to"))

    def archive(frames):
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if held:
            held.precompute_compress(3)
        packer = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=True, write_content_size=True)
        begun = False
        for frame in frames:
            ids, urls, payloads, refers = frame.column(0).to_pylist(), frame.column(1).to_pylist(), bytes_of(frame.column(2)), frame.column(3).to_pylist()
            out = []
            if not begun and ids:
                begun = True
                out += [struct.pack("<2I", DICTIONARY_MAGIC, len(dictionary)) + dictionary] if dictionary else []
                out.append(packer.compress(record("warcinfo", [("Content-Type", "application/warc-fields")], b"software: gaugemill\r\n")))
            out += [packer.compress(page_record(*row)) for row in zip(ids, urls, payloads, refers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    told.mapInArrow(archive, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(folder)


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstandard frame at ``at`` ends, from its header and its blocks' headers."""
    flags = data[at + 4]
    single, checked = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("a block of a reserved kind")
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * checked


def frames(data: memoryview) -> Iterator[bytes]:
    """The records of an archive, one frame each, decoded with the dictionary of its leading skippable frame."""
    unpacker, at, first = zstandard.ZstdDecompressor(), 0, True
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"the archive is cut off at byte {at}")
        magic, size = struct.unpack_from("<2I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise ValueError(f"the archive is cut off at byte {at}")
            if magic == DICTIONARY_MAGIC and first:
                held = bytes(data[at + 8 : at + 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompress(held)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            if end > len(data):
                raise ValueError(f"the archive is cut off at byte {at}")
            yield unpacker.decompress(data[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")
        first = False


def parse(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    """Kind, headers and block of a record; raises ValueError where its version, headers or lengths are wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {raw[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"a header without a colon: {line!r}")
        headers[key.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"headers are missing: {sorted(missing)}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {length}")
    return headers["warc-type"], headers, rest[:length]


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def read(spark: SparkSession, folder: str, keep_payload: bool = False) -> DataFrame:
    """Per page record page_id, payload_bytes, payload_digest, record_type and refers_to, with ``keep_payload`` also payload (null for revisits)."""

    def pages(files):
        for file in files:
            for content in file.column(0):
                rows = []
                for raw in frames(memoryview(content.as_buffer())):
                    kind, headers, body = parse(raw)
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = body.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of {headers['warc-record-id']} isn't what its headers say")
                    rows.append((page_of(headers["warc-record-id"]), size, digest, kind, page_of(headers.get("warc-refers-to")), payload if kind == "response" else None))
                    if len(rows) >= 2000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 if keep_payload else 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0").select("content")
    return files.mapInArrow(pages, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if keep_payload else ""))
