"""Token counts of whole texts by overlapping chunks that are joined at stable boundaries.

Every text takes the same path: it is cut into chunks of ``chunk`` characters that overlap, each chunk is encoded with offsets, and
neighbours are spliced at a place inside their overlap at which both begin a token and the text goes from a
non-space character of any kind to white space: no pre-token spans such a place, so neither side's tokens depend on the other. The
tokens between that place and the last such place in the overlap must agree too. Where the overlap has no place to splice at, or the chunks
disagree, it is doubled; where it reaches the left chunk's begin, that chunk is doubled, so the work stays in proportion
to the text. A text of up to ``chunk`` characters is one chunk.

A chunk is encoded part by part: the library encodes every distinct part once a task (``pieces``).

Results: null and empty texts have 0 bytes and 0 tokens. Very long texts are held whole in their task, their chunks one after the
other. Repeated rows give repeated rows, an empty table none. Columns of the input stay, but for the text; a column with the name
of a result is replaced.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import free_name, slices, texts_of
from gaugemill.llm.pieces import SPACES, WIDE, PieceCache, tokenizer

CHUNK_CHARS = 4096
OVERLAP_CHARS = 256
#: A place at which white space follows a non-space of any kind.
STABLE = re.compile(rf"(?<=[^{SPACES}{WIDE}])[{SPACES}]")


class TokenCounter:
    """Counts what ``Tokenizer.encode(text, add_special_tokens=False)`` gives for a byte-level BPE file."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.library, self.chunk, self.overlap = tokenizer(path), chunk, max(1, min(overlap, chunk // 3))
        self.cache = PieceCache(self.encode_parts, lower=False, spaced=True)
        self.shapes: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.widened = 0

    def encode_parts(self, found: list[str]) -> list[tuple[int, ...]]:
        """Where the tokens of each part begin; a character of several tokens counts for each."""
        begins = [tuple(a for a, _ in e.offsets) for e in self.library.encode_batch(found, add_special_tokens=False)]
        if len(self.shapes) > 100_000:
            self.shapes = {}
        return [self.shapes.setdefault(b, b) for b in begins]

    def starts(self, parts: list[str], known: dict, begin: int) -> list[int]:
        """Where the tokens of a chunk that starts at ``begin`` begin, in order, in characters of the whole text."""
        out = []
        for part in parts:
            own = known[part]
            out += [begin] if own == (0,) else [begin + a for a in own]
            begin += len(part)
        return out

    def encoded(self, text: str, begin: int, end: int) -> list[int]:
        parts = self.cache.split(text[begin:end])
        return self.starts(parts, self.cache.learn(parts), begin)

    def spliced(self, text: str) -> int:
        """The number of tokens of a text of several chunks."""
        total, begin, n = 0, 0, len(text)
        end = min(n, self.chunk)
        left = self.encoded(text, begin, end)
        while end < n:
            overlap = self.overlap
            while True:
                start = max(begin, end - overlap)
                stop = min(n, start + max(self.chunk, 2 * overlap))
                right = self.encoded(text, start, stop)
                cut = self.meeting(text, left, right, start, end)
                if cut is not None:
                    break
                self.widened += 1
                if start > begin:
                    overlap *= 2
                    continue
                end = min(n, begin + 2 * (end - begin))  # nothing to splice at: a chunk twice as long
                left, overlap = self.encoded(text, begin, end), self.overlap
                if end == n:
                    return total + len(left)
            total += sum(p < cut for p in left)
            left = [p for p in right if p >= cut]
            begin, end = cut, stop
        return total + len(left)

    @staticmethod
    def meeting(text: str, left: list[int], right: list[int], start: int, end: int) -> int | None:
        """The place in text[start:end], the overlap of two chunks, from which on the right one's tokens are to be taken."""
        here, both = [p for p in left if start < p < end], [p for p in right if start < p < end]
        common = set(here).intersection(both)
        places = [m.start() for m in STABLE.finditer(text, start + 1, end)]
        cut = next((p for p in reversed(places) if p in common), None)
        first = next((p for p in places if p in common), None)
        # the tokens from the first common place to the last must be the same on both sides
        if cut is None or [p for p in here if first <= p < cut] != [p for p in both if first <= p < cut]:
            return None
        return cut

    def tail(self, parts: list[str], known: dict, start: int, end: int) -> list[int]:
        """Where the tokens at ``start`` and after it begin, of a chunk that ends at ``end``; only the parts there are looked at."""
        out: list[int] = []
        for part in reversed(parts):
            if end <= start:
                break
            end -= len(part)
            out += [end + a for a in reversed(known[part])]
        return [p for p in reversed(out) if p >= start]

    def head(self, parts: list[str], known: dict, begin: int, end: int) -> list[int]:
        """Where the tokens before ``end`` begin, of a chunk that starts at ``begin``."""
        out: list[int] = []
        for part in parts:
            if begin >= end:
                break
            out += [begin + a for a in known[part]]
            begin += len(part)
        return [p for p in out if p < end]

    def chunks(self, n: int) -> list[tuple[int, int]]:
        """The chunks of a text of n characters."""
        step = max(1, self.chunk - self.overlap)
        return [(a, min(n, a + self.chunk)) for a in range(0, max(1, n - self.overlap), step)] if n > self.chunk else [(0, n)]

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for rows in slices(texts):
            cut = {i: self.chunks(len(texts[i])) for i in rows}
            parts = {i: [self.cache.split(texts[i][a:b]) for a, b in chunks] for i, chunks in cut.items()}
            known = self.cache.learn(chain.from_iterable(chain.from_iterable(parts.values())))
            again = []
            for i in rows:
                n = sum(sum(map(len, map(known.__getitem__, p))) for p in parts[i])
                for (start, end), (begin, _), left, right in zip(cut[i], cut[i][1:], parts[i], parts[i][1:], strict=False):
                    before, after = self.tail(left, known, begin, end), self.head(right, known, begin, end)
                    if (place := self.meeting(texts[i], before, after, begin, end)) is None:
                        again.append((len(out), texts[i]))
                        break
                    n -= sum(p >= place for p in before) + sum(p < place for p in after)
                out.append(n)
            for at, text in again:  # with wider overlaps
                out[at] = self.spliced(text)
        return out


_LOADED: dict[tuple, TokenCounter] = {}


def loaded(path: str, chunk: int, overlap: int) -> TokenCounter:
    """One counter a worker process."""
    if (path, chunk, overlap) not in _LOADED:
        _LOADED[path, chunk, overlap] = TokenCounter(path, chunk, overlap)
    return _LOADED[path, chunk, overlap]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {text, "n_bytes", "n_tokens", "over_limit"}]
    own = free_name(docs, "text")

    def batches(frames):
        counter = loaded(path, chunk, overlap)
        for frame in frames:
            n = pa.array(counter.counts(texts_of(frame.column(0))), pa.int64())
            yield pa.RecordBatch.from_arrays([*frame.columns[1:], n], [*frame.schema.names[1:], "n_tokens"])

    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    slim = docs.select(value.alias(own), *kept, F.octet_length(value).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(batches, slim.drop(own).schema.add("n_tokens", "long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
