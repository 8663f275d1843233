"""Phrases whose words stand together more often than their parts explain, mined by SON partitioning.

1. *Shards.* Documents are dealt out to ``SHARDS`` shards by a hash of id and text. A phrase with ``support`` occurrences in a
   language has, in at least one shard, its share of them: count * n >= support * n_shard, n being the language's words. So
   each shard is mined completely at its lowered support: its words, pairs of words that are candidates, longer phrases of such pairs.
   A shard is no task: each level is one aggregation over all shards with partial results.
2. *Union.* What is frequent in any shard is a candidate, unless its counts in all shards, with the most that shards without a kept count can
   add, stay below the support. Candidates go to the tasks as a bitmap of ``BITS`` bits by hash, of the same
   size for any input: a phrase that it lets through by chance is counted for nothing, none is lost.
3. *Count.* Words have been counted by then, all of them; one more pass counts the longer candidates exactly, by their words, not their hashes;
   ``support`` decides then.

Scores and the choice of phrases are joins and aggregations of the table of counts. Products are decimals of 38 digits.

Results: a null text has no words, a null language is ``und``. Words and pieces are bytes, so a very long text is cut at its
tokens, ``SLICE`` bytes at a time, whatever stands in it; a slice takes over the last three tokens of the one before it. Rows that
come twice count twice. Ties in score and count follow the phrase's bytes. A table without a frequent phrase, as an empty
one, gives no rows. Extra columns are ignored, whatever their names."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugemill.llm.common import bytes_of, discard, parallelism, scratch, sized, stored

SUPPORT, LONGEST, TOP = 30, 4, 2000
SHARDS = 2
#: Local counts from this one on are kept beside the frequent ones.
KNOWN = 4
#: Size of the bitmaps: 8 MB.
BITS = 26
#: The bits of a hash from which its places in a bitmap are taken.
SHIFTS = (0, 32)
#: Bytes of text that a task holds as tokens at a time, hashes and phrases it counts before it sends them on, words it knows, rows it takes apart at a time.
SLICE, TALLY, WORDS_KEPT, PHRASES_KEPT, ROWS = 2 << 20, 800_000, 200_000, 600_000, 2000
#: Words that a task knows in the first pass, which counts them.
FIRST_WORDS_KEPT = 400_000
#: A phrase goes when a longer one with so many hundredths of its occurrences holds it.
SUBSUMED = 80
SCALE = 2_000_000
#: Row salts of the first of two rankings: a language's rows never meet before each salt has kept its best.
SALTS = 64

#: Tabs are spaces, A-Z is lower-cased, what ends a piece is a full stop.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
DECIMAL = "decimal(38,0)"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Numbers(dict):
    """A number for each word, in the order in which words are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Tokens:
    """Numbers and hashes of words, the same ones in all slices of a task until ``WORDS_KEPT`` are known. 0 ends a piece."""

    def __init__(self):
        self.number = Numbers({b".": 0})
        self.hashes = np.zeros(1, np.uint64)

    def ids(self, found: list[bytes], most: int = WORDS_KEPT) -> np.ndarray:
        if len(self.number) > most:
            self.__init__()
        ids = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        if new := len(self.number) - len(self.hashes):
            words = islice(self.number, len(self.hashes), None)
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, new)])
        return ids


def token_slices(texts: list[bytes]) -> Iterator[tuple[list[bytes], int]]:
    """Tokens of texts, about ``SLICE`` bytes at a time, and how many of the first of them were in the slice before."""
    carried: list[bytes] = []
    held, size = [], 0
    for text in texts:
        for at in range(0, max(1, len(text)), SLICE):
            held.append(text[at : at + SLICE])
            size += len(held[-1])
            if size < SLICE:
                continue
            whole = b"".join(held).translate(_BYTES)
            cut = max(whole.rfind(b" "), whole.rfind(b".")) + 1 if at + SLICE < len(text) else len(whole)  # never within a word
            found = carried + whole[:cut].replace(b".", b" . ").split()
            yield found, len(carried)
            carried, held, size = found[1 - LONGEST :], [whole[cut:]], len(whole) - cut
        held.append(b".")
    if held:
        yield carried + b"".join(held).translate(_BYTES).replace(b".", b" . ").split(), len(carried)


class Slice:
    """A slice's tokens with the hashes of the phrases that begin at each of them."""

    def __init__(self, ids: np.ndarray, known: Tokens, lang: tuple[str, int], carried: int):
        self.ids, self.carried = ids, carried
        self.parts = known.hashes[ids]
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang[0]))

    def phrases(self, fits, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first places, hashes) of the phrases that end in this slice and that ``fits`` lets through, as all their beginnings, words and pairs."""
        inner = np.zeros(len(self.ids) + longest, bool)  # where a word, then a pair, that was let through begins
        at = np.flatnonzero(self.ids)
        h = mixed(self.seed + self.parts[at] * _FACTORS[0])
        for n in range(1, longest + 1):
            if n > 1:
                more = inner[at + (1 if n == 2 else n - 2)]
                at, h = at[more], h[more]
                h = mixed(h + self.parts[at + n - 1] * _FACTORS[n - 1])
            good = fits(h, n)
            at, h = at[good], h[good]
            if n < 3:
                inner[:] = False
                inner[at] = True
            own = at + n > self.carried
            yield n, at[own], h[own]


class Tally:
    """Counts of hashes by key, combined before they are sent on."""

    def __init__(self):
        self.held: dict[tuple, list] = defaultdict(list)
        self.size = 0

    def add(self, key: tuple, hashes: np.ndarray) -> None:
        found, count = np.unique(hashes, return_counts=True)
        self.held[key].append((found, count))
        self.size += len(found)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (shard, (_, lang)), parts in self.held.items():
            hashes, back = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
            count = np.zeros(len(hashes), np.int64)
            np.add.at(count, back, np.concatenate([c for _, c in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), shard, np.int32)), pa.array(np.full(len(hashes), lang, np.int64)), pa.array(hashes.view(np.int64)), pa.array(count)], ["shard", "lang", "h", "c"])
        self.held.clear()
        self.size = 0


def groups(frame: pa.RecordBatch, rows: int = ROWS) -> Iterator[tuple[int, tuple[str, int], list[bytes]]]:
    """A batch's texts by shard and language (its name and number), so many of its rows at a time."""
    for at in range(0, frame.num_rows, rows):
        part, found = frame.slice(at, rows), defaultdict(list)
        for shard, lang, number, text in zip(*(part.column(i).to_pylist() for i in range(3)), bytes_of(part.column(3)), strict=True):
            found[shard, (lang, number)].append(text)
        for (shard, lang), texts in found.items():
            yield shard, lang, texts


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a bitmap holds, by two places each."""
    held = np.ones(len(h), bool)
    for shift in SHIFTS:
        at = h >> np.uint64(shift) & np.uint64((1 << BITS) - 1)
        held &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return held


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes (h), built in Spark in blocks of 4 KB. At most 2^BITS bits come to the driver, however many rows there are."""
    place = lambda shift: F.shiftrightunsigned("h", shift).bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    blocks = hashes.select(F.explode(F.array(*map(place, SHIFTS))).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for block, part in blocks.collect():
        bits[(block - 1) * len(part) : block * len(part)] = np.frombuffer(part, np.uint8)
    return bits


COUNTS = "shard int, lang long, h long, c long"  # a language by its number, so that the aggregations have keys of numbers only


def word_counts(docs: DataFrame) -> DataFrame:
    """(shard, lang, h, word, c) of every word, told apart by its bytes; h = 0 holds a language's name and the number of all its words."""

    def count(frames):
        known, held, names = Tokens(), {}, {}

        def rows():
            words = pa.array(list(known.number), pa.binary())
            for (shard, lang), counts in held.items():
                at = np.flatnonzero(counts)
                h = mixed(np.uint64(xxhash.xxh3_64_intdigest(names[lang])) + known.hashes[at] * _FACTORS[0])
                h[h == 0] = 1
                total = pa.array([names[lang].encode()], pa.binary())
                columns = [np.concatenate([x.view(np.int64), [y]]) for x, y in ((h, 0), (counts[at], int(counts.sum())))]
                n = len(at) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, lang, np.int64)), pa.array(columns[0]), pa.concat_arrays([words.take(pa.array(at)), total]).cast(pa.string()), pa.array(columns[1])], ["shard", "lang", "h", "word", "c"])
            held.clear()

        for frame in frames:
            for shard, (name, lang), texts in groups(frame):
                for found, carried in token_slices(texts):
                    if len(known.number) > FIRST_WORDS_KEPT:
                        yield from rows()
                        known = Tokens()
                    ids = known.ids(found[carried:], FIRST_WORDS_KEPT)
                    counts = np.bincount(ids, minlength=len(known.number))
                    counts[0] = 0  # where a piece ends
                    if (before := held.get((shard, lang))) is not None:
                        counts[: len(before)] += before
                    held[shard, lang], names[lang] = counts, name
        yield from rows()

    return docs.mapInArrow(count, "shard int, lang long, h long, word string, c long").groupBy("shard", "lang", "h", "word").agg(F.sum("c").alias("c"))


def phrase_counts(docs: DataFrame, frequent: np.ndarray, least: int, most: int) -> DataFrame:
    """(shard, lang, h, c) of every phrase of ``least`` to ``most`` words in each shard, whose words and pairs, as far as these are shorter, are candidates."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def count(frames):
        known, tally = Tokens(), Tally()
        for frame in frames:
            for shard, lang, texts in groups(frame):
                fits = lambda h, n: has(sent.value, h) if n < min(least, 3) else np.ones(len(h), bool)
                for found, carried in token_slices(texts):
                    for n, _, h in Slice(known.ids(found), known, lang, carried).phrases(fits, most):
                        if n >= least:
                            tally.add((shard, lang), h)
                    if tally.size > TALLY:
                        yield from tally.rows()
        yield from tally.rows()

    return docs.mapInArrow(count, COUNTS).groupBy("shard", "lang", "h").agg(F.sum("c").alias("c"))


def same_words(ids: np.ndarray, at: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A first place and the number of places of each phrase among those at ``at``, told apart by their words."""
    _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if all(np.array_equal(ids[at + i], ids[at[first[back]] + i]) for i in range(n)):
        return at[first], count
    _, first, count = np.unique(ids[at[:, None] + np.arange(n)], axis=0, return_index=True, return_counts=True)  # two phrases with one hash
    return at[first], count


def exact_counts(docs: DataFrame, candidates: np.ndarray) -> DataFrame:
    """(lang, phrase, words, a) of every phrase of two words and more that the candidates' bitmap lets through: occurrences in all shards, counted by words."""
    sent = docs.sparkSession.sparkContext.broadcast(candidates)

    def count(frames):
        known, held = Tokens(), defaultdict(lambda: defaultdict(int))

        def rows():
            for (lang, n), counts in held.items():
                same = pa.array(np.zeros(len(counts), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(same), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(np.full(len(counts), n, np.int32)), pa.array(list(counts.values()), pa.int64())], ["lang", "phrase", "words", "c"])
            held.clear()

        for frame in frames:
            for _, lang, texts in groups(frame, 3 * ROWS):
                for found, carried in token_slices(texts):
                    ids = known.ids(found)
                    for n, at, h in Slice(ids, known, lang, carried).phrases(lambda h, n: has(sent.value, h)):
                        if n > 1 and len(at):
                            counts = held[lang[0], n]
                            for place, times in zip(*(x.tolist() for x in same_words(ids, at, h, n)), strict=True):
                                counts[b" ".join(found[place : place + n])] += times
                    if sum(map(len, held.values())) > PHRASES_KEPT:
                        yield from rows()
        yield from rows()

    return docs.mapInArrow(count, "lang string, phrase string, words int, c long").groupBy("lang", "phrase", "words").agg(F.sum("c").alias("a"))


def mine(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``LONGEST`` words with ``support`` occurrences in their language: (lang, phrase, words, a), and each language's number of words: (number, n)."""
    if not 1 <= shards <= 16:
        raise ValueError("shards must be 1 to 16")
    spark = docs.sparkSession
    folder = scratch(spark, "collocations")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(shards)).cast("int").alias("shard"), lang.alias("lang"), F.xxhash64(lang).alias("number"), text.alias("text"))
    words = stored(word_counts(dealt), f"{folder}/words")
    sizes = stored(words.filter("h = 0").groupBy("lang", "shard").agg(F.sum("c").alias("own"), F.max("word").alias("name")).withColumn("n", F.sum("own").over(Window.partitionBy("lang"))), f"{folder}/sizes")
    enough = F.col("c").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)") >= F.lit(support).cast("decimal(10,0)") * F.col("own").cast("decimal(19,0)")

    def frequent(counts: DataFrame) -> DataFrame:
        """h of what is frequent in a shard and may be so in all: counts from ``KNOWN`` on are kept, a shard without one has fewer."""
        kept = counts.join(sized(sizes, 100_000), ["lang", "shard"]).withColumn("enough", enough).filter(F.col("enough") | (F.col("c") >= KNOWN))
        return kept.groupBy("lang", "h").agg(F.bool_or("enough").alias("enough"), (F.sum("c") + (shards - F.count(F.lit(1))) * (KNOWN - 1)).alias("most")).filter(F.col("enough") & (F.col("most") >= support)).select("h")

    own = stored(frequent(words.filter("h <> 0")), f"{folder}/own")
    pairs = stored(frequent(phrase_counts(dealt, bitmap(own), 2, 2)), f"{folder}/pairs")
    short = own.unionByName(pairs)
    longer = stored(frequent(phrase_counts(dealt, bitmap(short), 3, LONGEST)), f"{folder}/longer")
    union = bitmap(short.unionByName(longer))
    single = words.filter("h <> 0").groupBy("lang", "word").agg(F.sum("c").alias("a")).filter(F.col("a") >= support)
    names = sized(stored(sizes.select("lang", "name").distinct(), f"{folder}/names"), 100_000)
    single = single.join(names, "lang").select(F.col("name").alias("lang"), F.col("word").alias("phrase"), F.lit(1).alias("words"), "a")
    phrases = exact_counts(dealt.withColumn("shard", F.lit(0)), union).filter(F.col("a") >= support)
    counted = stored(single.unionByName(phrases), f"{folder}/counted")
    discard(spark, *(f"{folder}/{name}" for name in ("words", "own", "pairs", "longer")))
    return counted, sizes.select(F.col("lang").alias("number"), "n").distinct()


def scored(counted: DataFrame) -> DataFrame:
    """Phrases of two words and more with a, l, r and score at their lowest-scoring cut, the least one among equals."""
    long = counted.filter("words > 1")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    piece = lambda first, n: F.array_join(F.slice(F.split("phrase", " "), first, n), " ")
    cuts = cuts.withColumn("head", piece(F.lit(1), F.col("k"))).withColumn("tail", piece(F.col("k") + 1, F.col("words")))
    of = lambda name, value: counted.select("lang", F.col("phrase").alias(name), F.col("a").alias(value)).hint("merge")
    both = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def covers(counted: DataFrame) -> DataFrame:
    """For each phrase within longer ones the most occurrences of any of these: (lang, phrase, most)."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, n), " "))))
    return counted.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counted, sizes = mine(docs, support, shards)
    whole = scored(counted).join(covers(counted).hint("merge"), ["lang", "phrase"], "left")
    kept = whole.filter(F.col("most").isNull() | (F.col("most").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * SUBSUMED))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.withColumn("number", F.xxhash64("lang")).join(sized(sizes, 100_000), "number").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
