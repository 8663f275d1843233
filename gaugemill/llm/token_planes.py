"""Token ids in binary files: fixed-size blocks of ids, transposed into planes, each plane compressed by zstandard.

A data set is a folder. ``shards/`` holds one file for each range of ids, ascending; ``chunks/`` is the
chunk index, a table with (shard, chunk, byte_offset, byte_length, n_ids, start), with which a reader can
fetch any block without the others. A file is a row of records, each followed by the marker ``SYNC``:

* blocks: ``B``, number of ids, number of planes, length of each plane, planes;
* at the end the footer: ``F`` and, compressed, the documents' ids and lengths and the blocks' offsets; then its
  length and ``GMF1``.

Planes are byte planes (all first bytes of the ids, all second bytes, ...) or bit planes. Files are written by Spark's
own writer, so its commit protocol covers lost tasks, and by any path that Spark can write.

Results: documents in ascending order of ``doc_id`` (null first), equal ids in that of a hash of their texts, so that one id may fill many shards. Null and empty
texts hold the end id alone. An empty table makes a data set without shards. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugemill.llm.common import parallelism, slices, stored, texts_of
from gaugemill.llm.pieces import LATIN, PieceCache, tokenizer

BLOCK_IDS = 65_536
#: Bytes of text that a shard holds about, whatever the size of the table.
SHARD_BYTES = 256 << 20
#: Words of letters, and how many of them the library gets in a row.
WORD, ROW_WORDS = re.compile(f"[{LATIN}]+"), 512
SYNC = "\n#GMSYNC"
TAIL, TAIL_BYTES = "<I4s", struct.calcsize("<I4s")
HEAD, HEAD_BYTES = "<cIB", struct.calcsize("<cIB")
#: Shards up to which the table of their first positions is sent to every executor.
BROADCAST_SHARDS = 1_000_000


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of little-endian 32-bit ids: 4 of bytes, or 32 of bits."""
    flat = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [p.tobytes() for p in np.packbits(np.unpackbits(flat, axis=1, bitorder="little"), axis=0).T]
    return [p.tobytes() for p in flat.T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    stack = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1) if planes else np.zeros((0, 4), np.uint8)
    if len(planes) == 32:
        stack = np.packbits(np.unpackbits(stack, axis=0, count=n), axis=1, bitorder="little")
    return np.ascontiguousarray(stack).view("<u4").ravel()


def block(ids: np.ndarray, bits: bool, packer: zstandard.ZstdCompressor) -> bytes:
    planes = [packer.compress(p) for p in to_planes(ids, bits)]
    return struct.pack(HEAD, b"B", len(ids), len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)) + b"".join(planes)


def read_block(data: memoryview, at: int, unpacker: zstandard.ZstdDecompressor) -> np.ndarray:
    kind, n, k = struct.unpack_from(HEAD, data, at)
    if kind != b"B":
        raise ValueError(f"no block at byte {at}")
    lengths = struct.unpack_from(f"<{k}I", data, at + HEAD_BYTES)
    begin, planes = at + HEAD_BYTES + 4 * k, []
    for length in lengths:
        planes.append(unpacker.decompress(data[begin : begin + length]))
        begin += length
    return from_planes(planes, n)


def block_bytes(data: memoryview, at: int) -> int:
    _, _, k = struct.unpack_from(HEAD, data, at)
    return HEAD_BYTES + 4 * k + sum(struct.unpack_from(f"<{k}I", data, at + HEAD_BYTES))


def footer(ids: list[int | None], lengths: list[int], offsets: list[int], counts: list[int]) -> bytes:
    null = np.array([i is None for i in ids], np.uint8)
    parts = [np.array([i or 0 for i in ids], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<i8").tobytes(), np.array(offsets, "<i8").tobytes(), np.array(counts, "<i8").tobytes()]
    packed = b"F" + struct.pack("<2I", len(ids), len(offsets)) + zstandard.ZstdCompressor().compress(b"".join(parts))
    return packed + struct.pack(TAIL, len(packed), b"GMF1")


def read_footer(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    end = len(data) - len(SYNC)
    length, magic = struct.unpack_from(TAIL, data, end - TAIL_BYTES)
    if bytes(data[end:]) != SYNC.encode() or magic != b"GMF1":
        raise ValueError("the file has no footer: it is cut off")
    at = end - TAIL_BYTES - length
    docs, blocks = struct.unpack_from("<2I", data, at + 1)
    raw = zstandard.ZstdDecompressor().decompress(data[at + 9 : at + length])
    out, begin = [], 0
    for n, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<i8"), (blocks, "<i8"), (blocks, "<i8")):
        out.append(np.frombuffer(raw, kind, n, begin))
        begin += out[-1].nbytes
    return tuple(out)


class LibraryEncoder:
    """Ids as the library gives them; it encodes every distinct part of the texts once a task.

    Words of letters go to it many at a time, with spaces between them, where the tokens that end a word tell their ids apart."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.cache = PieceCache(self.encode_parts, lower=True, spaced=False)
        self.ends = np.zeros(1 + max(self.library.get_vocab().values(), default=0), bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True

    def encode_parts(self, found: list[str]) -> list[bytes]:
        words = [p for p in found if WORD.fullmatch(p)] if self.ends.any() else []
        coded = dict(zip(words, self.encode_words(words), strict=True))
        others = [p for p in found if p not in coded]
        coded.update(zip(others, self.encode_each(others), strict=True))
        return [coded[p] for p in found]

    def encode_each(self, found: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(found, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        rows = [words[at : at + ROW_WORDS] for at in range(0, len(words), ROW_WORDS)]
        for row, e in zip(rows, self.library.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out += [raw[x:y] for x, y in pairwise([0, *ends])] if len(ends) == len(row) else self.encode_each(row)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        runs = [self.cache.split(t) for t in texts]
        known = self.cache.learn(chain.from_iterable(runs))
        return [b"".join(map(known.__getitem__, r)) for r in runs]


_LOADED: dict[str, LibraryEncoder] = {}


def loaded(path: str) -> LibraryEncoder:
    """One encoder a worker process."""
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def write(docs: DataFrame, folder: str, path: str, end_id: int, bits: bool = False, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text), ``end_id`` after each document, and write the data set.

    The texts are dealt out by ranges of doc_id and sorted in each; a task streams its range and holds one block."""
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * block_ids

    def shard(frames):
        encoder = loaded(path)
        packer = zstandard.ZstdCompressor(level=3)
        ids, lengths, offsets, counts, at, rest = [], [], [], [], 0, bytearray()

        def cut(n: int):
            nonlocal at
            offsets.append(at)
            counts.append(n)
            out = block(np.frombuffer(bytes(rest[: 4 * n]), "<u4"), bits, packer)
            del rest[: 4 * n]
            at += len(out) + len(SYNC)
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["value"])

        for frame in frames:
            ids += frame.column(0).to_pylist()
            texts = texts_of(frame.column(1))
            for rows in slices(texts):
                for coded in encoder.encode(texts[rows.start : rows.stop]):
                    lengths.append(len(coded) // 4 + 1)
                    rest += coded
                    rest += end
                    while len(rest) >= width:
                        yield cut(block_ids)
        if rest:
            yield cut(len(rest) // 4)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([footer(ids, lengths, offsets, counts)], pa.binary())], ["value"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(shards_for(slim), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    files = ranged.mapInArrow(shard, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", SYNC).text(f"{folder}/shards")
    index_of(spark, folder).write.parquet(f"{folder}/chunks")


def shards_for(docs: DataFrame) -> int:
    """As many shards as keep them at about ``SHARD_BYTES`` of text: files stay far below what a reader can take whole. It changes file sizes only."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(parallelism(docs.sparkSession), int(total / SHARD_BYTES) + 1)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards")
    return files.filter("length > 0").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content")


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk index, from the shards' footers."""

    def chunks(frames):
        for frame in frames:
            for shard, content in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                data = memoryview(content.as_buffer())
                _, _, _, offsets, counts = read_footer(data)
                n = len(offsets)
                length = [block_bytes(data, o) for o in offsets.tolist()]
                starts = np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(offsets), pa.array(length, pa.int64()), pa.array(counts), pa.array(starts)], ["shard", "chunk", "byte_offset", "byte_length", "n_ids", "local_start"])

    found = stored(files_of(spark, folder).mapInArrow(chunks, "shard long, chunk long, byte_offset long, byte_length long, n_ids long, local_start long"), f"{folder}/footers")
    base = first_positions(found)
    return found.join(small(base), "shard").select("shard", "chunk", "byte_offset", "byte_length", "n_ids", (F.col("local_start") + F.col("base")).alias("start"))


def first_positions(chunks: DataFrame) -> DataFrame:
    """Ids before each shard. One row a shard, so the running sum is over as many rows as there are files: 400,000 at 100 TB of text."""
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return sizes.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))


def small(base: DataFrame) -> DataFrame:
    return F.broadcast(base) if base.count() <= BROADCAST_SHARDS else base.hint("merge")


def read(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Per document doc_id, start, n_tokens, ids_crc32, with ``keep_ids`` also ids. Blocks are decoded one by one."""

    def documents(frames):
        unpacker = zstandard.ZstdDecompressor()
        for frame in frames:
            for shard, content in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                data = memoryview(content.as_buffer())
                ids, null, lengths, offsets, counts = read_footer(data)
                starts = np.cumsum(lengths) - lengths
                crcs, kept, doc, crc, left, own = [], [], 0, 0, int(lengths[0]) if len(lengths) else 0, bytearray()
                for offset, n in zip(offsets.tolist(), counts.tolist(), strict=True):
                    coded = read_block(data, offset, unpacker).tobytes()
                    if len(coded) != 4 * n:
                        raise ValueError(f"block at byte {offset} of shard {shard} has {len(coded) // 4} ids, its index {n}")
                    at = 0
                    while at < len(coded):
                        take = min(4 * left, len(coded) - at)
                        crc = zlib.crc32(coded[at : at + take], crc)
                        if keep_ids:
                            own += coded[at : at + take]
                        at += take
                        left -= take // 4
                        if not left:
                            crcs.append(crc)
                            if keep_ids:
                                kept.append(bytes(own))
                                own = bytearray()
                            doc, crc = doc + 1, 0
                            left = int(lengths[doc]) if doc < len(lengths) else 0
                columns = [pa.array([shard] * len(ids), pa.int64()), pa.array(ids, mask=null.astype(bool)), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_ids else []), ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])])

    schema = "shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    base = first_positions(spark.read.parquet(f"{folder}/chunks"))
    found = files_of(spark, folder).mapInArrow(documents, schema).join(small(base), "shard")
    return found.select("doc_id", (F.col("local_start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
