"""Quality by supervised subword embeddings: learned vectors of hashed word and character n-grams, averaged over a document,
and a softmax over the classes; trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.

The tokens of a document are its words (what stands between white space) and, for runs of words, what the run repeats. A
token's vector is the mean of the vectors of its features: the token itself, its characters' n-grams, its shape and its
affixes, each hashed to a row of one table. Because a document's vector is the mean over its tokens, a trained model
scores a token by one number, kept a worker for each distinct token.

Only text is an input. Results: null and empty texts have no tokens and get the score of the bias, which is learned
with the rest from an empty text beside every sample. Rows with a null label, or with labels that disagree, are not
trained on; of texts that no longer fit into the sample shorter ones after them do. Rows of the sample whose hashes are equal follow their ids, then
their texts. A very long text is scored whole. A document that comes twice is scored twice, an empty table gives none. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import free_name, portions, slices, texts_of

#: At most so many labelled rows are trained on, those whose ids hash lowest.
TRAIN_ROWS = 3000
#: At most so many characters of texts, taken row by row in the same order (whole texts only).
TRAIN_CHARS = 24_000_000
ROWS, DIM, EPOCHS, STEPS, RATE, GRAM = 1 << 16, 8, 4, 12_000, 0.5, 3  # as many rounds as give that many steps, EPOCHS at least
#: Tokens whose numbers a task keeps in each of two generations.
TOKENS_KEPT = 50_000
WORD = re.compile(r"[^ \t-\r]+")


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Shapes(dict):
    """A character's shape: A for upper case, a for letters, 0 for digits, else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = shape = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return shape


_SHAPES = _Shapes()
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def row_of(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % ROWS


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for tokens, one after the other, and how many each has: itself, its shape, its length, its characters' n-grams."""
    codes = np.frombuffer("".join(f"<{t}>" for t in found).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(t) + 2 for t in found])
    grams = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams += codes[i : len(codes) - GRAM + 1 + i] * _FACTORS[i]
    grams = ((grams ^ (grams >> np.uint64(31))) * _FACTORS[0] >> np.uint64(40)).astype(np.int64) % ROWS
    own = lengths - GRAM + 1  # a framed token has at least three characters
    inside = np.arange(own.sum()) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(own) - own), own)
    other = np.array([(row_of(f"\x02{t}"), row_of("\x01" + _RUN.sub(r"\1", t[:64].translate(_SHAPES))), row_of(f"\x03{min(len(t), 24)}")) for t in found], np.int64)
    counts = own + 3
    flat, at = np.empty(counts.sum(), np.int64), np.cumsum(counts) - counts
    for i in range(3):
        flat[at + i] = other[:, i]
    flat[np.arange(own.sum()) + np.repeat(at + 3 - (np.cumsum(own) - own), own)] = grams[inside]
    for i in [i for i, t in enumerate(found) if t[0] == "\t"]:  # what a run repeats has no characters of its own
        flat[at[i] : at[i] + counts[i]] = other[i, 0]
    return flat, counts


def tokens(text: str) -> list[str]:
    """Words, then for each 16 words a token that tells how many of them are new, and one for each pair of equal neighbours."""
    words = WORD.findall(text)
    extra = [f"\t{min(len(set(words[i : i + 16])), 16)}/{min(16, len(words) - i)}" for i in range(0, len(words), 16)] * 4
    new = len(set(words)) / max(1, len(words))
    extra += [f"\tnew{int(new * 10)}"] * len(words)
    extra += ["\tsame"] * sum(a == b for a, b in pairwise(words))
    return words + extra


class Model:
    """Vectors, softmax weights and biases; ``gain`` is what each row of the table adds to the log-odds of label 1."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.gain = (vectors @ (weights[1] - weights[0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])
        self.known: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def __getstate__(self):
        return {"gain": self.gain, "bias": self.bias, "known": {}, "old": {}}

    def forget(self) -> None:
        """Drop what is known of tokens, at a task's end: a worker that waits, or serves another operator, holds the table only."""
        self.known, self.old = {}, {}

    def token_gains(self, found: set[str]) -> dict[str, float]:
        if len(self.known) > TOKENS_KEPT:
            self.old, self.known = self.known, {}
        new = found.difference(self.known)
        if again := new.intersection(self.old):
            self.known.update((t, self.old[t]) for t in again)
            new -= again
        if new:
            flat, counts = features(unknown := list(new))
            sums = np.add.reduceat(self.gain[flat], np.cumsum(counts) - counts)
            self.known.update(zip(unknown, (sums / counts).tolist(), strict=True))
        return self.known

    def scores(self, texts: list[str]) -> list[float]:
        out = []
        for rows in slices(texts):
            split = [tokens(texts[i]) for i in rows]
            gain = self.token_gains({t for ts in split for t in ts})
            odds = np.array([sum(map(gain.__getitem__, ts)) / len(ts) if ts else 0.0 for ts in split]) + self.bias
            out += (1 / (1 + np.exp(-np.clip(odds, -50, 50)))).tolist()
        return out


def averaged(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a document and their shares in its mean."""
    counts: dict[str, int] = {}
    found = tokens(text)
    for t in found:
        counts[t] = counts.get(t, 0) + 1
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    flat, sizes = features(list(counts))
    share = np.repeat(np.fromiter(counts.values(), float) / len(found) / sizes, sizes)
    distinct, back = np.unique(flat, return_inverse=True)
    return distinct, np.bincount(back, share, len(distinct))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train on texts with labels 0 and 1; classes weigh alike, by the inverse of their rows."""
    rng = np.random.default_rng(seed)
    vectors, weights, bias = rng.uniform(-1, 1, (ROWS, DIM)) / DIM, rng.normal(0, 0.1, (2, DIM)), np.zeros(2)
    docs = [averaged(t) for t in texts]
    target = np.array(labels)
    count = np.bincount(target, minlength=2)
    weight = np.sqrt(len(target) / (2 * np.maximum(count, 1)))
    epochs = max(EPOCHS, STEPS // len(docs))
    steps, at = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rows, share = docs[i]
            mean = share @ vectors[rows] if len(rows) else np.zeros(DIM)
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            rate = RATE * (1 - at / steps) * weight[target[i]]
            vectors[rows] -= rate * np.outer(share, p @ weights) * 2
            weights -= rate * np.outer(p, mean)
            bias -= 0.02 * rate * p
            at += 1
    return Model(vectors, weights, bias)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: int = TRAIN_ROWS) -> DataFrame:
    """The sample (text, label): labelled rows outside fold 0, those whose ids hash lowest. Ids decide which rows, never a score."""
    key = F.col("doc_id").cast("string")
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(F.crc32(F.encode(key, "UTF-8")) % folds != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("most")).filter("label = most")
    known = known.select(F.col("doc_id").alias("__id"), "label", F.xxhash64(key).alias("order")).orderBy("order", "__id").limit(limit)
    own = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(known), "__id").orderBy("order", "__id", "text").limit(limit).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    texts, targets, size = [], [], 0
    for text, label in training_rows(docs, labels, limit=limit).toLocalIterator():
        if texts and size + len(text) > chars:
            continue  # a huge text leaves room for the shorter ones after it
        size += len(text)
        texts.append(text)
        targets.append(label)
    return fit([*texts, ""], [*targets, 0])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1, of label 1) and predicted (1 from ``threshold`` on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def batches(frames):
        for frame in (part for whole in frames for part in portions(whole)):
            scores = pa.array(sent.value.scores(texts_of(frame.column(0))), pa.float64())
            yield pa.RecordBatch.from_arrays([*frame.columns[1:], scores], [*frame.schema.names[1:], "score"])
        sent.value.forget()

    slim = kept.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias(free_name(kept, "whole")), "*")
    return slim.mapInArrow(batches, kept.schema.add("score", "double")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, as they are, that score ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(frames):
        for frame in (part for whole in frames for part in portions(whole)):
            good = [s >= threshold for s in sent.value.scores(texts_of(frame.column(0)))]
            yield pa.RecordBatch.from_arrays(frame.columns[1:], frame.schema.names[1:]).filter(pa.array(good, pa.bool_()))
        sent.value.forget()

    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias(free_name(docs, "whole")), "*").mapInArrow(batches, docs.schema)
