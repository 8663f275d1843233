"""Quality rules judged by host: failures of each rule are counted by domain, the domains' rates are shrunk by a beta prior
fitted to all of them, and domains whose shrunk rate is too high lose all their documents.

1. Every whole text is measured once: words, their characters, symbols, lines that repeat an earlier one, words in repeated
   windows. Windows are told apart by their words, by doubling: pairs, then fours, then eights, each a number of its own.
2. Failures of each rule are summed by host, with partial sums, so a host with a third of all rows is one row a task.
3. The prior of a rule is beta(a, b) by the moments of the hosts' rates: what their spread exceeds that of chance is the hosts'
   own. Without such an excess the prior is as strong as ``STRONGEST`` documents. A host with few documents stays near the mean.
4. Hosts beyond ``HOST_LIMIT`` are joined back to the measured rows (numbers, no texts).

A host is the domain of an address, lower-cased and without ``www.``, else the source as it stands.

Results: a null text is empty, without words, and fails. A null source is no host: its documents are judged alone. Rows with the same id
are judged by their own texts. A very long text is measured whole, in one task. An empty table gives no rows. Extra columns are
ignored by ``verdicts``; ``accepted`` keeps them, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import bytes_of, scratch, sized, slices, stored

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: A document fails by itself with fewer words, or with more hundredths of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A host fails at this shrunk rate of any rule; a prior weighs as many documents as its moments say, within these bounds.
HOST_LIMIT, WEAKEST, STRONGEST = 0.5, 1.0, 10_000.0
#: Hosts that fail are broadcast up to so many.
BROADCAST_HOSTS = 200_000

BASE: dict[str, Callable[[], Column]] = {
    "few words": lambda: F.col("n_words") < LEAST_WORDS,
    "repeated": lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED,
}
#: Rules that count against a host, never against a document by itself.
HOST_ONLY: dict[str, Callable[[], Column]] = {
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("word_chars"),
    "repeated lines": lambda: F.col("n_dup_lines") * 2 > F.col("n_lines"),
}


def pairs_of(values: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the pairs (values[i], values[i + step]) of the places ``at``, -1 elsewhere, and which places hold a pair that comes twice."""
    numbers, twice = np.full(len(values), -1), np.zeros(len(values), bool)
    _, back, count = np.unique(values[at] * (values.max(initial=0) + 1) + values[at + step], return_inverse=True, return_counts=True)
    numbers[at], twice[at] = back, count[back] > 1
    return numbers, twice


def repeated_words(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For texts of ``sizes`` words each, given as numbers one after the other: how many of a text's words lie in a window that comes twice in it."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)
    places = np.arange(len(words))
    own = np.unique(doc * (words.max(initial=0) + 1) + words, return_inverse=True)[1]  # a word of another text is another word
    values, at, step = own, places[places + 1 < last], 1
    while True:
        values, twice = pairs_of(values, at, step)
        step *= 2
        if step == WINDOW:
            break
        at = np.flatnonzero(twice)
        at = at[at + step < len(words)]
        at = at[twice[at + step]]
    marks = np.zeros(len(words) + 1, np.int64)
    begins = np.flatnonzero(twice)
    np.add.at(marks, begins, 1)
    np.add.at(marks, begins + WINDOW, -1)
    return np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=len(sizes))


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of each text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    found = [w for ws in split for w in ws]
    number = {w: i for i, w in enumerate(set(found))}
    chars = [sum(map(len, ws)) if t.isascii() else len(b"".join(ws).decode("utf-8", "surrogatepass")) for t, ws in zip(texts, split, strict=True)]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    repeats = repeated_words(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), sizes)
    return [sizes, np.array(chars), np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts]), np.array([len(x) for x in lines]), np.array([len(x) - len(set(x)) for x in lines]), repeats]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, which is its last one, and the measures."""

    def batches(frames):
        for frame in frames:
            texts = bytes_of(frame.column(frame.num_columns - 1))
            parts = [measure([texts[i] for i in rows]) for rows in slices(texts)]
            columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*frame.columns[:-1], *columns], [*frame.schema.names[:-1], *MEASURES])

    schema = docs.drop(docs.columns[-1]).schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    return docs.mapInArrow(batches, schema)


def host_of(source: Column) -> Column:
    address = F.lower(F.regexp_extract(source, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(address != "", F.regexp_replace(address, r"^www\.", "")).otherwise(source)


def host_rates(rows: DataFrame, rules: dict[str, Callable[[], Column]]) -> DataFrame:
    """(host, rule, n, failed, rate): the rate shrunk by the rule's prior."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(rule(), F.lit(False)).cast("long").alias("bad")) for name, rule in rules.items()])
    counted = rows.filter("host is not null").select("host", F.inline(each)).groupBy("host", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("failed"))
    number = lambda c: c.cast("decimal(38,6)")  # noqa: E731  # the same sums under any partitioning
    n, k = F.col("n"), F.col("failed")
    sums = counted.groupBy("rule").agg(F.count(F.lit(1)).cast("double").alias("hosts"), F.sum(n).cast("double").alias("all"), F.sum(k).cast("double").alias("bad"), F.sum(number(n.cast("double") * n)).cast("double").alias("squares"), F.sum(number(k.cast("double") * k / n)).cast("double").alias("spread"))
    mean = F.col("bad") / F.col("all")
    chance, degrees = mean * (1 - mean), F.col("hosts") - 1
    share = F.try_divide(F.try_divide(F.col("spread") - F.col("all") * mean * mean, chance) - degrees, F.col("all") - F.col("squares") / F.col("all") - degrees)
    strength = F.when(share > 0, F.least(F.greatest(1 / share - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(STRONGEST)
    priors = F.broadcast(sums.select("rule", mean.alias("mean"), strength.alias("strength")))  # a row a rule
    return counted.join(priors, "rule").select("host", "rule", "n", "failed", ((k + F.col("mean") * F.col("strength")) / (n + F.col("strength"))).alias("rate"))


def failing_hosts(rows: DataFrame, rules: dict[str, Callable[[], Column]], limit: float) -> DataFrame:
    return host_rates(rows, rules).filter(F.col("rate") >= limit).groupBy("host").agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("host_failed"))  # of a few rules


def judged(rows: DataFrame, limit: float, folder: str) -> DataFrame:
    """``rows`` (host and measures) with base_failed, host_failed (the rules, null where the host passes) and kept."""
    rows = stored(rows, f"{folder}/rows")
    bad = stored(failing_hosts(rows, BASE | HOST_ONLY, limit), f"{folder}/hosts")
    base = BASE["few words"]() | BASE["repeated"]()
    return rows.join(sized(bad, BROADCAST_HOSTS), "host", "left").withColumn("base_failed", base).withColumn("kept", ~base & F.col("host_failed").isNull())


def verdicts(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the measures, host, base_failed, host_failed and kept for every row of ``docs`` (doc_id, text and the host's column)."""
    slim = docs.select("doc_id", host_of(F.col(host).cast("string")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return judged(measured(slim), limit, scratch(docs.sparkSession, "host-rules"))


def accepted(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs``, as they are, whose own text and whose host pass."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), host_of(F.col(host).cast("string")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return judged(measured(rows), limit, scratch(docs.sparkSession, "host-rules")).filter("kept").select("row.*")
