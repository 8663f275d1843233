"""Fingerprints of documents as homomorphic multiset hashes of their paragraphs (lines).

A paragraph hashes to a wide vector, a document's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo
2^64 and 2^32. So documents with the same paragraphs in any order are equal, and a paragraph is inserted or deleted
by adding or subtracting its vector (``Fingerprint.edited``). The vector has two parts:

* 16 lanes modulo 2^64 from SHAKE-128 of the whole paragraph, for equality;
* 256 lanes modulo 2^32, to which each five-word shingle of the paragraph adds +1 or -1 at one place (a shorter paragraph
  is one shingle). The cosine of two documents' lanes estimates that of their shingle multisets: the likeness.

A written fingerprint holds both parts, so likenesses can be had from fingerprints alone (``Fingerprint.read``).

Results: null and empty texts are one empty paragraph. Equal fingerprints have likeness 1; otherwise a document without
words has likeness 0 with any other. Rows with equal doc_id follow each other in the order of their texts; null ids come
last. The only row of a table is its own next document; an empty table gives none. A very long text is hashed whole in its task. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import parallelism, texts_of

LANES, SKETCH, SHINGLE = 16, 256, 5
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
_WORDS: dict[str, int] = {}
WORDS_KEPT = 250_000


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the vectors of the paragraphs of ``text``."""
    paragraphs = text.split("\n")
    dense = np.frombuffer(b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * LANES) for p in paragraphs), "<u8").reshape(-1, LANES).sum(axis=0, dtype=np.uint64)
    flat, begins, at = [], [], 0
    for p in paragraphs:
        if words := p.split():
            words += [""] * (SHINGLE - len(words))
            flat += words
            begins.append(np.arange(at, at + len(words) - SHINGLE + 1))
            at += len(words)
    if not flat:
        return dense, np.zeros(SKETCH, np.uint32)
    hashes, first = word_hashes(flat), np.concatenate(begins)
    shingles = np.zeros(len(first), np.uint64)
    for i in range(SHINGLE):
        shingles += mixed(hashes[first + i]) * _FACTORS[i]
    shingles = mixed(shingles)
    sign = ((shingles >> np.uint64(55)) & np.uint64(1)).astype(np.int64) * 2 - 1
    return dense, np.bincount((shingles >> np.uint64(56)).astype(np.int64), sign, SKETCH).astype(np.int64).astype(np.uint32)


class Fingerprint:
    """A multiset of paragraphs, as the sum of their vectors."""

    def __init__(self, dense: np.ndarray, sketch: np.ndarray):
        self.dense, self.sketch = dense, sketch

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        return cls(*vector(text))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense + other.dense, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense - other.dense, self.sketch - other.sketch)

    def edited(self, old: str, new: str, same: int) -> Fingerprint:
        """Of ``new``, where this is that of ``old`` and the texts agree on their first ``same`` characters."""
        begin = old.rfind("\n", 0, same) + 1
        return self - Fingerprint.of(old[begin:]) + Fingerprint.of(new[begin:])

    @classmethod
    def read(cls, written: bytes) -> Fingerprint:
        """What ``bytes()`` gave."""
        return cls(np.frombuffer(written, "<u8", LANES), np.frombuffer(written, "<u4", SKETCH, 8 * LANES))

    def __bytes__(self) -> bytes:
        return self.dense.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()

    def likeness(self, other: Fingerprint) -> float:
        if np.array_equal(self.dense, other.dense):
            return 1.0
        a, b = self.sketch.view(np.int32).astype(float), other.sketch.view(np.int32).astype(float)
        size = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / size)) if size else 0.0


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id and text, descending, dealt out by ranges of doc_id; each range ends with the first row of the one after it (role 1).

    Only as many ids as there are ranges come to the driver."""
    spark, infinity = docs.sparkSession, float("inf")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(-F.col("doc_id").cast("double"), F.lit(infinity)).alias("key"))
    ranges = parallelism(spark)
    places = slim.select(F.when(F.col("key") < infinity, F.col("key")).alias("key")).na.drop().approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    splits = [-infinity, *sorted(set(places)), infinity]
    ranged = Bucketizer(splits=splits, inputCol="key", outputCol="range").transform(slim).withColumn("range", F.col("range").cast("int")) if places else slim.withColumn("range", F.lit(0))
    firsts = sorted((r["range"], r["key"]) for r in ranged.groupBy("range").agg(F.min("key").alias("key")).collect())
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    if not firsts:
        return slim.select("doc_id", "text", F.lit(0).alias("range"), F.lit(0).alias("role"))
    to = F.element_at(F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*map(F.lit, before.values()))), F.col("key"))
    own = F.struct(F.col("range"), F.lit(0).alias("role"))
    roles = F.when(F.col("key").isin(list(before)), F.array(own, F.struct(to.alias("range"), F.lit(1).alias("role")))).otherwise(F.array(own))
    dealt = ranged.select("doc_id", "text", "key", F.inline(roles)).repartitionById(len(splits) - 1, "range")
    return dealt.sortWithinPartitions("range", "role", "key", F.desc("doc_id"), "text").select("doc_id", "text", "range", "role")


def with_next(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text (its last third replaced from the next document, in descending
    order of doc_id), and both likenesses. Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited, near_next."""

    def pairs(frames):
        held, span = None, None
        for frame in frames:
            rows = []
            for doc_id, text, place, role in zip(frame.column(0).to_pylist(), texts_of(frame.column(1)), frame.column(2).to_pylist(), frame.column(3).to_pylist(), strict=True):
                if place != span:
                    held, span = None, place
                elif held is None:  # further rows with the id of the next range's first
                    continue
                mark = Fingerprint.of(text)
                if held is not None:
                    rows.append(edit(*held, text, mark))
                held = None if role else (doc_id, text, mark)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered(docs).mapInArrow(pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def edit(doc_id: int | None, text: str, mark: Fingerprint, after: str, after_mark: Fingerprint) -> tuple:
    third = len(text) // 3
    same = len(text) - third
    changed = text[:same] + after[:third]
    new = mark.edited(text, changed, same)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), bytes(mark), bytes(new), mark.likeness(new), mark.likeness(after_mark)
