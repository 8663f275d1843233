"""A positional inverted index over documents, and exact phrase and proximity matches against it.

The index is partitioned by document, as search engines do it: a segment holds some documents, one sorted list of
positions for each of their terms, and the documents' ids and lengths. Positions count through a segment with a
gap between documents, so a phrase is an intersection of lists shifted by the terms' offsets, and no phrase crosses
documents. A query starts from the rarest term and intersects in order of rarity; a term that a segment lacks ends it.

No term's list is gathered from the whole corpus: however frequent it is, it stays spread over the segments.
The phrases searched for go to the executors in blocks of at most ``BLOCK_BYTES``, each checked by its size, one at a time.

Results: a null or empty text has no words. A document may come twice; each row is judged on its own. An item without
words has no window and is never found. Items with equal texts are each found. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm.common import bytes_of, discard, portions, scratch, stored

#: Words of a segment, after which a new one begins with the next document.
SEGMENT_WORDS = 1_000_000
#: Bytes of item texts in a block that is sent to the executors.
BLOCK_BYTES = 16 << 20
WINDOW = 10
#: Contaminated documents up to which their ids are sent to every executor (8 bytes each).
BROADCAST_DOCS = 1_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: digits, ASCII letters and all beyond ASCII."""
    return WORD.findall(text.lower())


class Segment:
    """One segment: documents, terms, and each term's positions in ascending order."""

    def __init__(self, ids: list, lengths: np.ndarray, terms: list[bytes], begins: np.ndarray, positions: np.ndarray):
        self.ids, self.lengths, self.begins, self.positions = ids, lengths, begins, positions
        self.terms = {t: i for i, t in enumerate(terms)}
        self.firsts = np.cumsum(lengths + 1) - (lengths + 1)  # position of each document's first word

    @staticmethod
    def columns(ids: list, lengths: list[int], flat: list[bytes]) -> tuple:
        """What is stored of a segment: its terms, their counts and their positions."""
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int32, len(flat))
        sizes = np.array(lengths, np.int64)
        position = np.arange(len(flat), dtype=np.int64) + np.repeat(np.arange(len(lengths)), sizes)
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(known)).astype("<i4")
        pack = zstandard.ZstdCompressor(level=1).compress
        gaps = np.diff(position[order], prepend=0).astype("<i4")
        planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
        return ids, sizes, pack(b"\n".join(known)), pack(counts.tobytes()), pack(planes.tobytes())

    @classmethod
    def stored(cls, ids: list, lengths: list[int], terms: bytes, counts: bytes, gaps: bytes) -> Segment:
        unpack = zstandard.ZstdDecompressor().decompress
        n = np.frombuffer(unpack(counts), "<i4")
        planes = np.frombuffer(unpack(gaps), np.uint8).reshape(4, -1)
        positions = np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64))
        raw = unpack(terms)
        return cls(ids, np.array(lengths, np.int64), raw.split(b"\n") if len(n) else [], np.concatenate([[0], np.cumsum(n)]), positions)

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.begins[term] : self.begins[term + 1]]

    def phrase(self, terms: Iterable[int]) -> np.ndarray:
        """Positions at which the terms follow each other."""
        order = sorted(enumerate(terms), key=lambda x: self.begins[x[1] + 1] - self.begins[x[1]])
        at = self.list_of(order[0][1]) - order[0][0]
        for offset, term in order[1:]:
            if not len(at):
                break
            own = self.list_of(term)
            place = np.searchsorted(own, at + offset)
            place[place == len(own)] = 0
            at = at[own[place] == at + offset]
        return at

    def near(self, terms: Iterable[int], within: int) -> np.ndarray:
        """Documents (by place in the segment) with a stretch of ``within`` words that holds all of the terms."""
        lists = [self.list_of(t) for t in dict.fromkeys(terms)]
        at = np.concatenate(lists)
        which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(at, kind="stable")
        at, which = at[order], which[order]
        newest = np.full((len(lists), len(at)), -1, np.int64)
        for i in range(len(lists)):
            newest[i] = np.maximum.accumulate(np.where(which == i, at, -1))
        oldest = newest.min(axis=0)
        ok = (oldest >= 0) & (at - oldest < within)
        docs = self.doc_of(at[ok])
        return np.unique(docs[docs == self.doc_of(oldest[ok])])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, at, side="right") - 1


SEGMENT = "segment string, doc_ids array<long>, lengths array<long>, terms binary, counts binary, gaps binary"


def build(docs: DataFrame, folder: str, segment_words: int = SEGMENT_WORDS) -> None:
    """Write the index of ``docs`` (doc_id, text), a row for each segment. Nothing is shuffled."""

    def segments(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, flat = [], [], []

        def close():
            columns = (uuid.uuid4().hex, *Segment.columns(ids, lengths, flat))
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], ["segment", "doc_ids", "lengths", "terms", "counts", "gaps"])

        for frame in (part for whole in frames for part in portions(whole, 1)):
            for doc_id, text in zip(frame.column(0).to_pylist(), bytes_of(frame.column(1)), strict=True):
                words = words_of(text)
                ids.append(doc_id)
                lengths.append(len(words))
                flat += words
                if len(flat) >= segment_words:
                    yield close()
                    ids, lengths, flat = [], [], []
        if ids:
            yield close()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim.mapInArrow(segments, SEGMENT).write.parquet(folder)


def item_blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items' ids (as strings) and words, in blocks of about ``limit`` bytes of text. Equal rows count once."""
    block, size = [], 0
    for item, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct().toLocalIterator():
        words = words_of((text or "").encode())
        if words:
            block.append((item, words))
            size += len(text.encode())
            if size >= limit:
                yield block
                block, size = [], 0
    if block:
        yield block


def hits_in(segment: Segment, items: list[tuple[str, list[bytes]]], window: int) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which positions of a segment lie in an occurrence of a window, and each document's items."""
    total = int(segment.lengths.sum() + len(segment.lengths))
    edge = np.zeros(total + 1, np.int32)
    found: dict[int, set[str]] = {}
    done: dict[tuple, np.ndarray] = {}
    for item, words in items:
        codes = [segment.terms.get(w, -1) for w in words]
        width = min(window, len(codes))
        lacking = np.cumsum([0] + [c < 0 for c in codes])
        for i in np.flatnonzero(lacking[width:] == lacking[:-width]).tolist():
            key = tuple(codes[i : i + width])
            if key not in done:
                done[key] = segment.phrase(key)
                np.add.at(edge, done[key], 1)
                np.add.at(edge, done[key] + width, -1)
            for doc in np.unique(segment.doc_of(done[key])).tolist():
                found.setdefault(doc, set()).add(item)
    return np.cumsum(edge[:-1]) > 0, found


def search(spark: SparkSession, folder: str, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from the index in ``folder``."""
    index = spark.read.schema(SEGMENT).parquet(folder)
    blocks = item_blocks(items, block_bytes)
    ahead = [next(blocks, None), next(blocks, None)]
    many = ahead[1] is not None

    def matches(block, frames):
        for frame in frames:
            for row in frame.to_pylist():
                segment = Segment.stored(row["doc_ids"], row["lengths"], row["terms"], row["counts"], row["gaps"])
                hit, found = hits_in(segment, block.value if block else [], window)
                marks = np.concatenate([[0], np.cumsum(hit)])
                begin, stop = segment.firsts, segment.firsts + segment.lengths
                n_hit = marks[stop] - marks[begin]
                names = [sorted(found.get(i, ()), key=lambda x: (x is None, x or "")) for i in range(len(segment.ids))]  # an item without an id is one, and adds nothing to the list
                places = [np.flatnonzero(hit[a:b]).astype(np.int32) if n and many else np.zeros(0, np.int32) for a, b, n in zip(begin.tolist(), stop.tolist(), n_hit.tolist(), strict=True)]
                columns = [pa.array(segment.ids, pa.int64()), pa.array(segment.lengths), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(segment.ids)), pa.int64()), pa.array([row["segment"]] * len(segment.ids)), *columns], ["place", "segment", "doc_id", "n_words", "n_hit", "items", "places"])

    schema = "place long, segment string, doc_id long, n_words long, n_hit long, items array<string>, places array<int>"
    found = lambda b: index.mapInArrow(lambda frames: matches(b, frames), schema)
    if many:  # one block at a time is at the executors; a document's hits from several may overlap
        path = scratch(spark, "blocks")
        for i, block in enumerate(chain(ahead, blocks)):
            sent = spark.sparkContext.broadcast(block)
            found(sent).write.parquet(f"{path}/block={i}")
            sent.destroy()
        both = spark.read.schema(schema).parquet(*[f"{path}/block={k}" for k in range(i + 1)])
        one = both.groupBy("segment", "place", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"))
    else:
        one = found(spark.sparkContext.broadcast(ahead[0]) if ahead[0] else None)
    return one.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def near(spark: SparkSession, folder: str, phrases: list[tuple[str, str]], within: int) -> DataFrame:
    """Documents with a stretch of ``within`` words that holds all words of a phrase: rows (name, doc_id)."""
    wanted = [(name, words_of(text.encode())) for name, text in phrases]

    def matches(frames):
        for frame in frames:
            for row in frame.to_pylist():
                segment = Segment.stored(row["doc_ids"], row["lengths"], row["terms"], row["counts"], row["gaps"])
                rows = [(name, segment.ids[d]) for name, words in wanted if words and all(w in segment.terms for w in words) for d in segment.near([segment.terms[w] for w in words], within).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["name", "doc_id"])

    return spark.read.schema(SEGMENT).parquet(folder).mapInArrow(matches, "name string, doc_id long")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those whose id is one of a document that holds a window of an item."""
    folder = scratch(docs.sparkSession, "phrases")
    build(docs, f"{folder}/index")
    found = search(docs.sparkSession, f"{folder}/index", items, window).filter("contaminated").select(F.col("doc_id").alias("__hit")).distinct()
    found = stored(found, f"{folder}/found")
    discard(docs.sparkSession, f"{folder}/index")
    side = F.broadcast(found) if found.count() <= BROADCAST_DOCS else found.hint("merge")
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["__hit"]), "left_anti")


def clean_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose own text holds a window of an item: rows are told apart by a hash of id and text, not by id."""
    folder = scratch(docs.sparkSession, "phrases")
    mark = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    build(docs.select(mark.alias("doc_id"), "text"), f"{folder}/index")
    found = search(docs.sparkSession, f"{folder}/index", items, window).filter("contaminated").select(F.col("doc_id").alias("__hit")).distinct()
    found = stored(found, f"{folder}/found")
    discard(docs.sparkSession, f"{folder}/index")
    side = F.broadcast(found) if found.count() <= BROADCAST_DOCS else found.hint("merge")
    return docs.join(side, mark == side["__hit"], "left_anti")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Index ``docs`` in the shared scratch folder and judge each of them against ``items`` (item_id, text)."""
    folder = scratch(docs.sparkSession, "phrases")
    build(docs, f"{folder}/index")
    found = stored(search(docs.sparkSession, f"{folder}/index", items, window), f"{folder}/found")
    discard(docs.sparkSession, f"{folder}/index")
    return found
