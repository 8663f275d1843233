"""Exact Jaccard join of documents by their word n-grams: universe partition, pigeonhole, exact verification.

Sets of sizes p and q with p q-overlap of at least ``num/den`` differ in at most u = (p + q)(den - num)/(den + num) elements.

1. *Classes.* Documents with equal sets are one class; from here on classes are compared, copies are only members.
2. *Size bands.* Bands of sizes overlap so that any two sets that can link lie in a common one. In a band all elements
   are hashed to the same m segments. If u + 1 segments each had a difference, the sets would differ too much: so some segment's
   subset is equal, or, where a segment is allowed one deletion and counts twice, equal after one deletion on either side.
   An index entry (signature) is the hash of a segment's subset, or of one less an element. A band's allocation - how many
   segments are exact, how many take one-deletion neighbourhoods - is the cheapest for the band's number of documents.
   Only a set's first u + 1 non-empty exact segments count: the first one that is equal and not empty has
   a rank of at most u + 1 on both sides. Sets with fewer non-empty ones share an entry of their own.
3. *Buckets.* Classes with a signature in common. Entries are shuffled once, and those of one class alone fall there. A signature
   with many classes within a task's texts goes out salted, so no bucket meets in one task. Buckets with the same members are one.
4. *Hubs.* In a bucket beyond ``BLOCK`` members every member is first compared with ``HUBS`` of them, and what links is one part
   from there on: near copies in large groups cost work in proportion to their number. Members outside the largest part are dealt
   out as blocks that meet each other and the blocks of the rest.
5. *Forests.* Classes carry a bitmap of element parities; two bitmaps differ in at most as many bits as the sets differ in elements, so
   pairs beyond u fall at once, and of the rest only a spanning forest is emitted.
6. *Verification.* Hubs' and forests' pairs are compared by whole texts. Where one fails, its buckets emit what pairs the bitmaps
   leave between different components, and these are verified too: no link between components is lost.

Elements are 64-bit hashes of shingles, and a class is known by a 64-bit hash of its set.

Results: null and empty texts, and texts without words, have an empty set and link with nothing. A text of fewer than k words is
one shingle. Repeated rows and equal texts are linked. Rows with a null doc_id take part; the smallest id of a component skips
nulls. Very long texts have bands of their own; a text is held whole in one task, its entries in proportion. An empty table gives
an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import bytes_of, discard, parallelism, portions, scratch, sized, stored
from gaugemill.llm.components import components

#: Members of a bucket that are compared with one another in one task.
BLOCK = 256
#: Members of a larger bucket with which all others are compared first.
HUBS = 8
#: Entries that a task sorts at a time, and classes with one signature among them from which on it is salted.
CHUNK_ENTRIES, HOT = 250_000, 8
#: Documents of a task that are described at a time, and classes whose entries it needn't send again; they change no result.
CHUNK_DOCS, SENT_KEPT = 50_000, 100_000
#: Buckets, or rows to remove, up to whose number a table of their ids is broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000
#: Elements that two unrelated sets of a band have in common, for the cost of their chance meetings in a bucket.
SHARED = 1.0
#: Segments beyond the needed ones that an allocation may spend, so that few sets have too many empty ones.
SPARE, SPARE_SHARES = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32), (64, 32, 24, 16, 12, 8, 6, 4)
BAND = 1.25
#: Classes up to whose number their documents are picked by a broadcast of their ids (16 bytes each).
BROADCAST_CLASSES = 500_000
#: Hashes of words that a worker keeps: none, as hashing them again is faster than looking them up.
_WORDS: dict[bytes, int] = {}
#: Bytes of texts that are described at once, and elements that are dealt to segments at once.
GROUP_BYTES, GROUP_ELEMENTS = 1 << 19, 1 << 17
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Times the usual partitions into which entries are dealt out, so that a task sorts fewer of them.
FINER = 3


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mixed_int(*values: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(repr(values).encode()))


def sets_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts, one after the other, and their sizes. A set: sorted 64-bit hashes of the distinct k-word shingles, or of all words if they are fewer."""
    split = [text.lower().split() for text in texts]
    words = np.array([len(w) for w in split], np.int64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(split))), ">u8").astype(np.uint64)
    width = np.minimum(words, k)
    made = np.where(words > 0, words - width + 1, 0)
    ends = np.cumsum(made)
    at, wide = np.arange(made.sum()) + np.repeat(np.cumsum(words) - words - (ends - made), made), np.repeat(width, made)
    out = wide.astype(np.uint64)
    for i in range(k):
        longer = mixed(out * GOLDEN + h[np.minimum(at + i, len(h) - 1)])
        out = np.where(wide > i, longer, out)
    for stop, n in zip(ends.tolist(), made.tolist(), strict=True):
        out[stop - n : stop].sort()
    new = np.concatenate([[True], out[1:] != out[:-1]])[: len(out)]
    new[(ends - made)[made > 0]] = True
    return out[new], np.bincount(np.repeat(np.arange(len(texts)), made)[new], minlength=len(texts))


def shingles(text: bytes, k: int) -> np.ndarray:
    """The set of a text."""
    return sets_of([text], k)[0]


def key_of(elements: np.ndarray) -> int:
    """The class of a set."""
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


class Bands:
    """Size bands and their allocations for a threshold num/den."""

    def __init__(self, num: int, den: int, longest: int, documents: dict[int, int]):
        """``documents``: about how many have a size of the band's own; it changes costs only."""
        self.num, self.den = num, den
        self.first = [1]
        while self.first[-1] <= longest:
            self.first.append(max(self.first[-1] + 1, math.ceil(self.first[-1] * BAND)))
        self.plans = [self.plan(j, documents.get(j, 0)) for j in range(len(self.first) - 1)]
        # of each band: its first size, its last, segments with one deletion, all, numbers that tell it, its segments and its short sets
        self.low, self.high = np.array(self.first, np.int64), np.array([self.last(j) for j in range(len(self.plans))], np.int64)
        self.deleting, self.segments = np.array(self.plans, np.int64).T
        self.salts, self.segment_salts, self.short = (np.array([mixed_int(*told) for told in each], np.uint64) for each in ([(j,) for j in range(len(self.plans))], [(j, m) for j, (_, m) in enumerate(self.plans)], [(j, -1) for j in range(len(self.plans))]))

    def differ(self, total: int) -> int:
        """The most elements in which linked sets of together ``total`` elements differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def last(self, j: int) -> int:
        return (self.first[j + 1] - 1) * self.den // self.num

    def plan(self, j: int, documents: int) -> tuple[int, int]:
        """(segments with one deletion, all segments)."""
        need = self.differ(self.first[j + 1] - 1 + self.last(j)) + 1
        size = (self.first[j] + self.first[j + 1]) / 2
        best = None
        for d in sorted({0, need // 8, need // 4, need // 2, (need + 1) // 2}):
            exact = max(0, need - 2 * d)
            for spare in {*SPARE, *(exact // s for s in SPARE_SHARES)} if exact else {0}:
                m = max(1, d + exact + spare)
                subset = size / m
                entries = d * (1 + subset) + exact
                # two sets meet by chance where a segment holds one of their common elements and nothing else, or all but one
                chance = SHARED * math.exp(-2 * subset) * ((exact + d * (1 + 2 * subset)) / m)
                empty = (exact + spare) * math.exp(-subset)
                short = math.exp(min(0.0, (spare + 1) * math.log(empty) - math.lgamma(spare + 2))) if exact else 0.0
                cost = entries + documents * (chance + short**2)
                if best is None or cost < best[0]:
                    best = (cost, d, m)
        return best[1:]

    def home(self, size: int) -> int:
        return int(np.searchsorted(self.first, size, side="right")) - 1

    def bits(self, size: int) -> int:
        """Width of a set's bitmap; a power of two that doesn't shrink with size."""
        return 1 << max(8, (8 * self.differ(2 * self.last(self.home(size)))).bit_length())

    def bitmaps(self, elements: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Of each set; none of an empty one."""
        width = np.array([self.bits(n) if n else 0 for n in sizes.tolist()], np.int64)
        ends = np.cumsum(width)
        bit = (mixed(elements) & np.repeat(np.maximum(width, 1) - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(ends - width, sizes)
        packed = np.packbits((np.bincount(bit, minlength=width.sum()) & 1).astype(np.uint8), bitorder="little").tobytes()
        return [packed[(stop - w) // 8 : stop // 8] for stop, w in zip(ends.tolist(), width.tolist(), strict=True)]

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """All index entries of a set."""
        return np.unique(self.signatures_of(elements, np.array([len(elements)]))[0])

    def signatures_of(self, elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All index entries of sets, and the number of each one's set."""
        start, home = np.cumsum(sizes) - sizes, np.searchsorted(self.low, sizes, side="right") - 1
        sets, bands, needs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        on, back = np.flatnonzero(home >= 0), 0
        while len(on := on[home[on] >= back]) and len(on := on[self.high[home[on] - back] >= sizes[on]]):
            j = home[on] - back
            most = np.minimum(self.high[j], sizes[on] * self.den // self.num) if not back else self.low[j + 1] - 1
            need = self.differ(sizes[on] + most) + 1
            some = need > 1  # else only equal sets link, and they are one class
            sets.append(on[some])
            bands.append(j[some])
            needs.append(need[some])
            back += 1
        own, band, need = map(np.concatenate, (sets, bands, needs))
        out, at, ends = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0, np.cumsum(sizes[own])
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_ELEMENTS, "right")))
            found, which = self.in_bands(elements, start[own[at:stop]], sizes[own[at:stop]], band[at:stop], need[at:stop])
            out.append((found, own[at:stop][which]))
            at = stop
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def in_bands(self, elements: np.ndarray, start: np.ndarray, size: np.ndarray, band: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index entries of pairs of a set (from ``start`` on, ``size`` elements) and a band, and the number of each one's pair."""
        half, deleting, m = np.uint64(32), self.deleting[band], self.segments[band]
        which = np.repeat(np.arange(len(size)), size)
        inside = elements[np.arange(len(which)) + np.repeat(start - (np.cumsum(size) - size), size)]
        first = np.cumsum(m) - m  # all pairs' segments lie one after the other
        segment = ((mixed(inside ^ self.salts[band][which]) >> half) * m.astype(np.uint64)[which] >> half).astype(np.int64)
        place, content = segment + first[which], mixed(inside + GOLDEN)
        low = np.bincount(place, (content & np.uint64(0xFFFFFFFF)).astype(float), m.sum()).astype(np.uint64)
        high = np.bincount(place, (content >> half).astype(float), m.sum()).astype(np.uint64)
        subset = low + (high << half)
        pair = np.repeat(np.arange(len(m)), m)
        nth = np.arange(len(pair)) - first[pair]
        salt = mixed(nth.astype(np.uint64) + self.segment_salts[band][pair])
        d = np.minimum(deleting, (need + 1) // 2)
        whole, one_less = nth < d[pair], segment < d[which]
        rest = need - 2 * d
        filled = (nth >= deleting[pair]) & (np.bincount(place, minlength=len(pair)) > 0)
        upto = np.cumsum(filled)
        exact = filled & (upto - (upto - filled)[first][pair] <= rest[pair])
        short = (rest > 0) & (np.bincount(pair[filled], minlength=len(m)) < rest)
        told = place[one_less]
        out = [mixed(subset[whole] ^ salt[whole]), mixed((subset[told] - content[one_less]) ^ salt[told]), mixed(subset[exact] ^ salt[exact]), self.short[band[short]]]
        return np.concatenate(out), np.concatenate([pair[whole], which[one_less], pair[exact], np.flatnonzero(short)])


def allocated(docs: DataFrame, k: int, num: int, den: int) -> Bands:
    """Bands with allocations for these documents, from a count of their words (by spaces: for costs it is near enough)."""
    words = F.length("text") - F.length(F.translate("text", " \n\t", "")) + 1
    powers = docs.groupBy(F.floor(F.log(BAND, F.greatest(words, F.lit(1)))).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest")).collect()
    longest = max([8, *((r["longest"] or 0) for r in powers)])  # a text has fewer shingles than characters
    bands = Bands(num, den, longest, {})
    counts: dict[int, int] = {}
    for r in powers:
        if r["p"] is not None:
            j = bands.home(max(1, round(BAND ** (r["p"] + 0.5)) - k + 1))
            counts[j] = counts.get(j, 0) + r["n"]
    return Bands(num, den, longest, counts)


ENTRIES = "bucket long, key long, salt int, info binary"
MEMBERS = "bucket long, key long, doc_id long, place long, n_shingles long, bits binary"
INFO, INFO_BYTES = "<?qqq", struct.calcsize("<?qqq")


class Entries:
    """A task's index entries: collected, sorted by signature, salted where a signature has many classes."""

    def __init__(self):
        self.buckets, self.keys, self.n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, signatures: np.ndarray, keys: np.ndarray) -> None:
        self.buckets.append(signatures.view(np.int64))
        self.keys.append(keys)
        self.n += len(signatures)

    def batch(self, docs: list[tuple[int, bytes]], at: int) -> pa.RecordBatch:
        """Everything collected, and rows of documents (key, info), which ``at`` numbers."""
        bucket, key = np.concatenate(self.buckets), np.concatenate(self.keys)
        order = np.argsort(bucket)
        bucket, key = bucket[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(bucket)))
        # the first two of a hot signature go unsalted, so that it is known to be shared wherever the rest of it goes
        rank = np.arange(len(bucket)) - np.repeat(first, sizes)
        hot = (np.repeat(sizes, sizes) >= HOT) & (rank >= 2)
        salt = np.where(hot, 1 + (mixed(key.view(np.uint64)) % np.uint64(1 << 20)).astype(np.int64), 0)
        place = mixed(np.arange(at, at + len(docs), dtype=np.uint64)).view(np.int64)
        info = pa.array([None] * len(bucket) + [d[1] for d in docs], pa.binary())
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([bucket, place])), pa.array(np.concatenate([key, np.array([d[0] for d in docs], np.int64)])), pa.array(np.concatenate([salt, np.full(len(docs), -1)]).astype(np.int32)), info], ["bucket", "key", "salt", "info"])


def indexed(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """In one pass over the texts and one shuffle: a row (bucket, key) for each entry whose signature several classes have, and
    one without bucket for each document: key (null if its set is empty), doc_id, place, n_shingles, bits."""

    def entries(frames):
        found, docs, sent, at = Entries(), [], set(), 0
        for frame in (part for whole in frames for part in portions(whole, 1, GROUP_BYTES)):
            elements, sizes = sets_of(bytes_of(frame.column(1)), k)
            keys, new, stop = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool), 0
            for i, (n, bits, doc_id, place) in enumerate(zip(sizes.tolist(), bands.bitmaps(elements, sizes), frame.column(0).to_pylist(), frame.column(2).to_pylist(), strict=True)):
                stop += n
                key = key_of(elements[stop - n : stop]) if n else 0
                docs.append((key, struct.pack(INFO, doc_id is None, doc_id or 0, place, n) + bits))
                if n and key not in sent:
                    sent.add(key)
                    keys[i], new[i] = key, True
            signatures, own = bands.signatures_of(elements[np.repeat(new, sizes)], sizes[new])
            found.add(signatures, keys[new][own])
            if found.n >= CHUNK_ENTRIES or len(docs) >= CHUNK_DOCS:
                yield found.batch(docs, at)
                at, docs = at + len(docs), []
                if len(sent) >= SENT_KEPT:  # only here, so that a class comes once in a batch
                    sent.clear()
        yield found.batch(docs, at)

    def shared(frames):
        held = None  # the last entry, which may go on
        for frame in frames:
            table = pa.Table.from_batches([frame])
            info = table.column("info").to_pylist()
            bucket, key, salt = (table.column(c).to_numpy() for c in ("bucket", "key", "salt"))
            cold = np.flatnonzero(salt == 0)
            b, o = bucket[cold], key[cold]
            if held is not None:
                b, o = np.concatenate([[held[0]], b]), np.concatenate([[held[1]], o])
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (o[1:] != o[:-1])]) if len(b) else np.zeros(0, bool)
            b, o = b[new], o[new]
            same = b[1:] == b[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(b) else new
            if len(b):  # its run may go on in the next batch; whether it is kept already is told along
                known = bool(keep[-1]) or (held is not None and held[2] and b[-1] == held[0])
                if held is not None and held[2]:
                    keep[0] = True
                    keep[1:] |= b[1:] == held[0]
                out = np.flatnonzero(keep[:-1])
                held, b, o = (b[-1], o[-1], known), b[out], o[out]
            hot = np.flatnonzero(salt > 0)
            yield rows(np.concatenate([b, bucket[hot]]), np.concatenate([o, key[hot]]), [(int(key[i]), info[i]) for i in np.flatnonzero(salt < 0)])
        if held is not None and held[2]:
            yield rows(np.array([held[0]]), np.array([held[1]]), [])

    def rows(bucket, key, docs):
        n = len(bucket)
        told = [struct.unpack_from(INFO, i) for _, i in docs]
        columns = [
            pa.array([*bucket.tolist(), *[None] * len(docs)], pa.int64()), pa.array([*key.tolist(), *(d[0] if t[3] else None for d, t in zip(docs, told, strict=True))], pa.int64()), pa.array([None] * n + [None if t[0] else t[1] for t in told], pa.int64()),
            pa.array([None] * n + [t[2] for t in told], pa.int64()), pa.array([None] * n + [t[3] for t in told], pa.int64()), pa.array([None] * n + [i[INFO_BYTES:] or None for _, i in docs], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "doc_id", "place", "n_shingles", "bits"])

    sent = docs.select("doc_id", "text", "place").mapInArrow(entries, ENTRIES).repartition(FINER * parallelism(docs.sparkSession), "bucket", "salt")
    return sent.sortWithinPartitions("bucket", "key").mapInArrow(shared, MEMBERS)


class Bucket:
    """Classes of a bucket: keys, sizes, bitmaps folded to one width, components and blocks."""

    def __init__(self, keys, sizes, bits, parts, blocks):
        width = min(map(len, bits))
        rows = []
        for b in bits:
            row = np.frombuffer(b, np.uint64)
            while row.nbytes > width:
                row = row[: len(row) // 2] ^ row[len(row) // 2 :]
            rows.append(row)
        self.keys, self.sizes, self.bits, self.parts, self.blocks = np.array(keys, np.int64), np.array(sizes, np.int64), np.stack(rows), np.array(parts, np.int64), np.array(blocks, np.int64)
        self.pair_of_blocks = len(set(blocks)) > 1

    def beyond(self, i: int, num: int, den: int) -> np.ndarray:
        """For class i and every other: differing bits, or -1 where they can't link or needn't be looked at here."""
        apart = np.bitwise_count(self.bits ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        total = self.sizes + self.sizes[i]
        ok = (apart <= most_apart(total, num, den)) & (self.parts != self.parts[i])
        if self.pair_of_blocks:
            ok &= self.blocks != self.blocks[i]
        ok[i] = False
        return np.where(ok, apart, -1)

    def forest(self, num: int, den: int) -> list[tuple[int, int, int]]:
        """Edges of a forest of least differing bits that joins whatever possible links join."""
        n = len(self.keys)
        far = 1 << 40
        distance, source, waiting, out = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool), []
        while waiting.any():
            i = int(np.where(waiting, distance, far + 1).argmin())
            if distance[i] < far:
                out.append((i, int(source[i]), int(distance[i])))
            waiting[i] = False
            apart = self.beyond(i, num, den)
            nearer = waiting & (apart >= 0) & (apart < distance)
            distance[nearer], source[nearer] = apart[nearer], i
        return out

    def all_pairs(self, num: int, den: int) -> list[tuple[int, int, int]]:
        return [(i, int(o), int(a[o])) for i in range(len(self.keys)) for a in [self.beyond(i, num, den)] for o in np.flatnonzero(a >= 0) if o > i]


def dealt(members: DataFrame, folder: str) -> DataFrame:
    """Rows (bucket, key, size, bits, part) with the cells (low, high) of blocks in which they meet others. A bucket that is one part is left out.

    Small buckets are one block. In a larger one the largest part's blocks meet only those of the other members."""
    parts = members.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("main"))
    large = stored(parts.filter(F.col("n") > BLOCK), f"{folder}/large")
    one, large = sized(large.filter("n = most").select("bucket"), BROADCAST_IDS), sized(large.filter("n > most"), BROADCAST_IDS)
    small = members.join(one, "bucket", "left_anti").join(large.select("bucket"), "bucket", "left_anti").select("bucket", "key", "size", "bits", "part", F.lit(0).alias("block"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    own = F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")
    rest = F.ceil(F.col("most") / BLOCK).cast("int")
    spread = members.join(large, "bucket").withColumns({"own": own, "rest": rest, "main": F.col("part") == F.col("main")})
    block = F.when(F.col("main"), F.col("own") + F.pmod(F.xxhash64("key"), F.col("rest"))).otherwise(F.pmod(F.xxhash64("key"), F.col("own"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("main"), F.col("own")).otherwise(F.col("own") + F.col("rest")) - 1)
    turns = F.transform(others, lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    return small.unionByName(spread.withColumn("block", block).select("bucket", "key", "size", "bits", "part", "block", F.inline(turns)))


def candidates(members: DataFrame, num: int, den: int, every: bool, folder: str) -> DataFrame:
    """Pairs (bucket, a, b) of classes that may link, from rows (bucket, key, size, bits, part); with ``every`` all of them, else a forest of each bucket.

    Classes come in the order of their keys, so that buckets of nearly the same classes take the same ones of equally good pairs."""
    cells = dealt(members, folder).repartition(parallelism(members.sparkSession), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "key")

    def batches(frames):
        held, name = [], None

        def pairs():
            if len(held) < 2:
                return []
            bucket = Bucket(*zip(*[h[:5] for h in held], strict=True))
            found = bucket.all_pairs(num, den) if every else bucket.forest(num, den)
            return [(name[0], min(held[i][0], held[o][0]), max(held[i][0], held[o][0])) for i, o, _ in found]

        for frame in frames:
            out = []
            for bucket, key, size, bits, part, own, low, high in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if name != (bucket, low, high):
                    out += pairs()
                    held, name = [], (bucket, low, high)
                held.append((key, size, bits, part, own))
            yield pair_batch(out)
        yield pair_batch(pairs())

    return cells.mapInArrow(batches, "bucket long, a long, b long")


def pair_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "a", "b"])


def with_hubs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (bucket, a, b) of each member of a large bucket and the likest of its hubs. Hubs are the members whose keys hash lowest, so
    that a group's buckets mostly have the same; they are dealt out to all parts of their bucket."""
    least = [F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("order"), "key", "size", "bits")).alias(f"hub{i}") for i in range(HUBS)]
    hubs = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *least).filter(F.col("n") > BLOCK)
    hubs = hubs.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.array_distinct(F.array(*[f"hub{i}" for i in range(HUBS)])).alias("hubs"))
    known = sized(hubs.select("bucket", "parts"), BROADCAST_IDS)
    salted = members.join(known, "bucket").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    hubs = hubs.select("bucket", "hubs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    both = salted.select("bucket", "salt", "key", "size", "bits").join(hubs.hint("merge"), ["bucket", "salt"]).select("bucket", "key", "size", "bits", "hubs")

    def batches(frames):
        for frame in frames:
            out = []
            for bucket, key, size, bits, hubs in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                others = [h for h in hubs if h["key"] != key]
                if len(others) < len(hubs):  # a hub meets all the others
                    out += [(bucket, min(key, h["key"]), max(key, h["key"])) for h in others if parities(bits, h["bits"]) <= most_apart(size + h["size"], num, den)]
                    continue
                apart, near = min(((parities(bits, h["bits"]) - most_apart(size + h["size"], num, den), h["key"]) for h in others), default=(1, 0))
                if apart <= 0:
                    out.append((bucket, min(key, near), max(key, near)))
            yield pair_batch(out)

    return both.mapInArrow(batches, "bucket long, a long, b long")


def most_apart(total, num: int, den: int):
    """The most elements in which linked sets of together ``total`` elements differ."""
    return total - 2 * -(-num * total // (num + den))


def parities(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, folded to the width of the narrower one."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def busy(pairs: DataFrame, own: str, folder: str) -> DataFrame:
    """Classes ``own`` with very many pairs, and the parts into which these go."""
    counts = pairs.groupBy(own).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    return sized(stored(counts, f"{folder}/busy_{own}"), BROADCAST_IDS)


def met(pairs: DataFrame, texts: DataFrame, own: str, other: str, name: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the text of their class ``own`` as ``name``. A class with very many pairs (``hot``) is dealt out to several tasks."""
    left = pairs.join(hot, own, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    right = texts.select(F.col("key").alias(own), F.col("text").alias(name)).join(hot, own, "left")
    right = right.select(own, name, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
    return left.join(right.hint("merge"), [own, "salt"]).drop("salt")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, folder: str) -> DataFrame:
    """``pairs`` (a, b), a stored table, with ``linked``, by the whole texts of one document of each class."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes.select("key", "rep", "place").hint("merge"), "key").select("key", "rep", "place"), f"{folder}/wanted")
    if wanted.isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long, linked boolean")
    side = sized(wanted, BROADCAST_CLASSES)
    own = docs["doc_id"].eqNullSafe(side["rep"]) & (docs["place"] == side["place"])
    texts = stored(docs.join(side, own).select("key", "text"), f"{folder}/texts")
    if texts.count() > wanted.count():  # rows of the same id and text
        texts = texts.dropDuplicates(["key"])
    hot = {own: busy(pairs, own, folder) for own in ("a", "b")}
    both = met(met(pairs, texts, "a", "b", "x", hot["a"]), texts, "b", "a", "y", hot["b"]).select("a", "b", "x", "y")

    def judge(frames):
        name, x = None, None
        for frame in frames:
            linked = []
            for a, left, right in zip(frame.column(0).to_pylist(), bytes_of(frame.column(2)), bytes_of(frame.column(3)), strict=True):
                if a != name:
                    name, x = a, shingles(left, k)
                y = shingles(right, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(judge, "a long, b long, linked boolean")


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per document doc_id, n_shingles and component_id, the smallest doc_id that links of ``num``/``den`` or more reach."""
    return linked(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int, num: int, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id. Documents without words all stay, but for repeated rows.

    Texts are shuffled only where a row is repeated, or where more than ``BROADCAST_IDS`` rows go."""
    folder = scratch(docs.sparkSession, "one")
    found = linked(docs, k, num, den)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    best = found.filter(stays).groupBy("doc_id", "component").agg(F.min("place").alias("best"))
    best = best.select(F.col("doc_id").alias("id"), F.col("best").alias("place")).distinct()
    rows = stored(found.groupBy(F.col("doc_id").alias("id"), "place").agg(F.count(F.lit(1)).alias("n")), f"{folder}/rows")
    same = rows["id"].eqNullSafe(best["id"]) & (rows["place"] == best["place"])
    gone = sized(stored(rows.join(best.hint("merge"), same, "left_anti").select("id", "place"), f"{folder}/gone"), BROADCAST_IDS)
    same = rows["id"].eqNullSafe(best["id"]) & (rows["place"] == best["place"])
    twice = sized(stored(rows.filter("n > 1").join(best.hint("merge"), same, "left_semi").select("id", "place"), f"{folder}/twice"), BROADCAST_IDS)
    own, place = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    is_one = lambda side: own.eqNullSafe(side["id"]) & (place == side["place"])
    kept = docs.join(gone, is_one(gone), "left_anti")
    once = kept.join(twice, is_one(twice), "left_anti")
    return once.unionByName(kept.join(twice, is_one(twice), "left_semi").dropDuplicates(["doc_id", "text"]))


def linked(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per document doc_id, place, n_shingles, component (a class of it) and component_id."""
    spark = docs.sparkSession
    folder = scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.xxhash64("text"))  # tells rows of one doc_id apart
    bands = allocated(docs, k, num, den)
    index = stored(indexed(docs, k, bands), f"{folder}/index")
    found = index.filter("bucket is null").drop("bucket")
    filled = found.filter("key is not null")
    classes = filled.groupBy("key").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("place", "doc_id"), F.min("place")).alias("place"), F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))
    classes = stored(classes, f"{folder}/classes")

    entries = stored(index.filter("bucket is not null").select("bucket", "key").distinct(), f"{folder}/entries")
    # buckets of the same classes are one; the few large ones are told apart by a table that is sent to their members
    sums = stored(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")), f"{folder}/sums")
    kept = sums.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).filter("n > 1")
    large = sized(sums.filter(F.col("n") > BLOCK).select("bucket"), BROADCAST_IDS)
    small = entries.join(large, "bucket", "left_anti").join(kept.filter(F.col("n") <= BLOCK).select("bucket").hint("merge"), "bucket", "left_semi")
    members = small.unionByName(entries.join(sized(kept.filter(F.col("n") > BLOCK).select("bucket"), BROADCAST_IDS), "bucket", "left_semi"))
    members = stored(members.join(classes.hint("merge"), "key").select("bucket", "key", "size", "bits"), f"{folder}/members")
    discard(spark, f"{folder}/entries", f"{folder}/sums")

    first = stored(with_hubs(members, num, den), f"{folder}/hubs")
    met_hubs = stored(first.select("a", "b").distinct(), f"{folder}/met")
    judged = stored(verified(met_hubs, docs, classes, k, num, den, f"{folder}/first"), f"{folder}/judged0")
    links = judged.filter("linked").select("a", "b")
    parts = stored(components(links, f"{folder}/parts0"), f"{folder}/part0")
    # what hubs have shown needn't be shown again
    emitted = stored(candidates(in_parts(members, parts, f"{folder}/second"), num, den, False, f"{folder}/second"), f"{folder}/forest")
    fresh = stored(emitted.select("a", "b").distinct().join(judged.hint("merge"), ["a", "b"], "left_anti"), f"{folder}/fresh")
    judged = judged.unionByName(stored(verified(fresh, docs, classes, k, num, den, f"{folder}/second"), f"{folder}/judged"))
    links = judged.filter("linked").select("a", "b")
    parts = stored(components(links, f"{folder}/parts"), f"{folder}/part")
    discard(spark, f"{folder}/first", f"{folder}/second")

    # where a pair of a forest failed, look at all pairs between the components so far
    open_buckets = sized(stored(emitted.join(judged.filter("not linked").hint("merge"), ["a", "b"]).select("bucket").distinct(), f"{folder}/open"), BROADCAST_IDS)
    again = in_parts(members.join(open_buckets, "bucket", "left_semi"), parts, f"{folder}/third")
    rest = candidates(again, num, den, True, f"{folder}/third").select("a", "b").distinct().join(judged.hint("merge"), ["a", "b"], "left_anti")
    rest = stored(rest, f"{folder}/rest")
    late = verified(rest, docs, classes, k, num, den, f"{folder}/third").filter("linked").select("a", "b")
    parts = stored(components(links.unionByName(late), f"{folder}/all"), f"{folder}/component")

    named = classes.select("key", "rep").join(parts.withColumnRenamed("node", "key").hint("merge"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least.hint("merge"), "component").select("key", "component", "component_id")
    own = filled.select("doc_id", "place", "key", "n_shingles").join(named.hint("merge"), "key").drop("key")
    empty = found.filter("key is null").select("doc_id", "place", "n_shingles", F.col("place").alias("component"), F.col("doc_id").alias("component_id"))
    result = stored(own.unionByName(empty), f"{folder}/result")
    discard(spark, *(f"{folder}/{x}" for x in ("index", "classes", "members", "hubs", "met", "forest", "fresh", "open", "third", "judged0", "judged", "parts0", "part0", "parts", "part", "rest", "all", "component")))
    return result


def in_parts(members: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """``members`` with the component of their class, or the class itself; written, as blocks are dealt from it several times."""
    own = members.join(parts.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("bucket", "key", "size", "bits", F.coalesce("component", "key").alias("part"))
    return stored(own, f"{folder}/parts")
