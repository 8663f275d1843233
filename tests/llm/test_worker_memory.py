"""What a Python worker holds at a time, and keeps for the tasks after it."""

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pyarrow as pa

from gaugemill.llm import bpe, jaccard, quality
from gaugemill.llm.common import portions


def test_portions_hold_few_texts_and_all_rows():
    texts = ["ä" * 400, None, "", "x" * 9000, *["word " * 50] * 100]
    frame = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(portions(frame, 1, limit=2000))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts and [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) + 64 for t in p.column(1).to_pylist()) <= 2000 for p in parts)
    assert list(portions(frame.slice(0, 0), 1)) == []
    assert [p.num_rows for p in portions(frame.slice(3), 1, limit=1)] == [1] * (len(texts) - 3)


def test_parts_are_forgotten_between_tasks():
    encoder = bpe.SpeculativeBpe(P.path("word_bpe_49k.json"))
    before = encoder.encode(["some words, some more"])
    assert encoder.cache.limit <= 60_000 and encoder.cache.values
    encoder.cache.forget()
    assert not encoder.cache.values and not encoder.cache.old and encoder.encode(["some words, some more"]) == before


def test_workers_keep_no_words_of_ended_tasks(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 9, 0) for i in range(40)], "doc_id long, text string, place long").repartition(4)
    model = quality.fit(["good words", "bad bad bad"], [1, 0])
    sent = spark.sparkContext.broadcast(model)

    def held(frames):
        from gaugemill.llm import jaccard

        for frame in frames:
            yield pa.RecordBatch.from_arrays([pa.array([len(jaccard._WORDS)] * frame.num_rows)], ["n"])

    jaccard.indexed(docs, 3, jaccard.allocated(docs, 3, 90, 100)).count()
    left = spark.range(64, numPartitions=8).mapInArrow(held, "n long").agg({"n": "max"}).first()[0]
    assert left == 0
    sent.value.scores(["good words"])
    assert sent.value.known
    sent.value.forget()
    assert not sent.value.known and not sent.value.old and sent.value.scores(["good words"]) == model.scores(["good words"])


def test_entries_are_sorted_in_many_tasks(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of some words", 0) for i in range(20)], "doc_id long, text string, place long")
    index = jaccard.indexed(docs, 3, jaccard.allocated(docs, 3, 90, 100))
    assert index.rdd.getNumPartitions() == jaccard.FINER * int(spark.conf.get("spark.sql.shuffle.partitions")) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stages_take_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(6000, numPartitions=1).selectExpr("id doc_id", "repeat('some words ', 500) text")

    def held(frames):
        for frame in frames:
            yield pa.RecordBatch.from_arrays([pa.array([frame.nbytes])], ["n"])

    most = lambda: docs.mapInArrow(held, "n long").agg({"n": "max"}).first()[0]
    spark.conf.unset(name)
    assert most() > 5 * corpus_pipeline.BATCH_BYTES
    corpus_pipeline.personal_data(spark, docs.limit(1), "")
    assert most() < 1.1 * corpus_pipeline.BATCH_BYTES
    spark.conf.set(name, "1000000")
    corpus_pipeline.personal_data(spark, docs.limit(1), "")
    assert spark.conf.get(name) == "1000000"
    spark.conf.unset(name)


def test_texts_are_described_together(monkeypatch):
    """Many at once as each alone, empty and short ones among them, and with many portions of elements."""
    monkeypatch.setattr(jaccard, "GROUP_ELEMENTS", 300)
    rng = np.random.default_rng(5)
    texts = [b"", b"one", b"Two words", b" \t ", *[" ".join(f"w{x}" for x in rng.integers(0, 60, n)).encode() for n in rng.integers(1, 400, 60)], b""]
    for k, num in ((3, 90), (5, 80), (2, 50)):
        bands = jaccard.Bands(num, 100, 4000, {j: 1000 for j in range(12)})
        elements, sizes = jaccard.sets_of(texts, k)
        signatures, own = bands.signatures_of(elements, sizes)
        ends = np.cumsum(sizes)
        for i, text in enumerate(texts):
            words = text.lower().split()
            alone = elements[ends[i] - sizes[i] : ends[i]]
            assert sizes[i] == len({tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1)) if words})
            assert alone.tolist() == sorted(set(alone.tolist())) == jaccard.shingles(text, k).tolist()
            assert sorted(signatures[own == i].tolist()) == bands.signatures(alone).tolist()
            bits = bands.bitmaps(elements, sizes)[i]
            assert bits == (bands.bitmaps(alone, sizes[i : i + 1])[0] if sizes[i] else b"") and len(bits) * 8 == (bands.bits(sizes[i]) if sizes[i] else 0)
