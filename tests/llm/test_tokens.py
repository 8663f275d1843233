"""BPE, counts and plane files against the library itself."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugemill.llm import bpe, token_counts, token_planes

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", "   ", "a\x1cb", "don't DON'T we'll 's 'S x'y'z", "<|endoftext|>x<|startoftext|> <|foo", "ab<|ENDOFTEXT|>", "naïve é, ́x é, x", "ĲIİ ǅ ß ﬁ ı", "日本語テスト 中文", "a b c　d\x85e", "١٢٣ ½ ²", "🙂🙂 ok🙂!",
    "x" * 5000, "aaaa'''s!!'t", "Σίσυφος ΣΑΣ", "0123456789" * 40, "tab\tnl\n\nff\x0cvt\x0b  end ", "\x00\x01\x7f", "EAEA!! the### thin%%% a1b2,c3", "word " * 3000, " 日" * 300 + "ab" * 400,
]


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def ids(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode(docs, library):
    clash = docs.withColumn("n_tokens", F.lit("old")).withColumn("ids", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r for r in bpe.encode(clash, WORD, keep_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        want = ids(library, WORD, t)
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want, t
        assert got[i]["decoded"] == library[WORD].decode(want, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(want) and got[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abethrn sABé,.'!<|>1́ß日\t\xa0"), max_size=60))
def test_any_text(text):
    one = bpe.loaded(WORD)
    assert np.frombuffer(one.encode([text])[0], "<u4").tolist() == one.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abs Aé,.'1日\t\n   \xa0\xa0\x85\u2003\u3000\x1c\u200b"), max_size=60))
def test_any_count(text):
    for chunk, overlap in ((32_768, 512), (300, 20), (20, 4), (16, 3)):
        one = token_counts.loaded(BYTE, chunk, overlap)
        assert one.counts([text]) == [len(one.library.encode(text, add_special_tokens=False).ids)]


def test_huge_texts_without_a_place_to_splice():
    one = token_counts.loaded(BYTE, 4096, 256)
    texts = ["x" * 60_000, "\xa0 " * 20_000, "ab" * 3000 + " " + "word " * 3000 + "é" * 9000, " " * 30_000 + "y"]
    assert one.counts(texts) == [len(one.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert one.widened


@pytest.mark.parametrize("text", ["x" + " \xa0" * 4 + " y", "x\xa0 ", "x \xa0\xa0 \xa0\xa0 y", "a\xa0 b\xa0\n\xa0 c \u3000 d", "\xa0 " * 50 + "z"])
def test_white_space_of_both_kinds(text):
    for chunk, overlap in ((32_768, 512), (16, 3)):
        one = token_counts.loaded(BYTE, chunk, overlap)
        assert one.counts([text]) == [len(one.library.encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 512), (300, 20), (60, 1)])
def test_counts(docs, library, chunk, overlap):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, BYTE, 100, chunk=chunk, overlap=overlap).collect()}
    for i, t in enumerate(TEXTS):
        n = len(ids(library, BYTE, t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100), t


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(spark, docs, library, tmp_path, bits):
    both = docs.union(spark.createDataFrame([(3, "again"), (None, "no id")], "doc_id long, text string"))
    folder = str(tmp_path / "set")
    token_planes.write(both, folder, WORD, end_id=1, bits=bits, block_ids=97)
    got = sorted(token_planes.read(spark, folder, keep_ids=True).collect(), key=lambda r: r["start"])
    order = [(None, "no id"), *sorted([*enumerate(TEXTS), (3, "again")], key=lambda x: (x[0], x[1] or ""))]
    at = 0
    for row, (doc_id, t) in zip(got, order, strict=True):
        raw = np.array([*ids(library, WORD, t), 1], "<u4").tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"], bytes(row["ids"])) == (doc_id, at, len(raw) // 4, zlib.crc32(raw), raw)
        at += len(raw) // 4
    chunks = spark.read.parquet(f"{folder}/chunks").orderBy("start").collect()
    assert sum(c["n_ids"] for c in chunks) == at and chunks[-1]["start"] + chunks[-1]["n_ids"] == at
    # a block is read by the index alone
    files = {int(p.name.split("-")[1]): p for p in (tmp_path / "set/shards").glob("part-*") if p.stat().st_size}
    data = memoryview(files[chunks[1]["shard"]].read_bytes())
    import zstandard

    assert len(token_planes.read_block(data, chunks[1]["byte_offset"], zstandard.ZstdDecompressor())) == chunks[1]["n_ids"]
    with pytest.raises((ValueError, struct.error)):
        token_planes.read_footer(data[:-3])


def test_words_go_to_the_library_in_rows():
    """The library gets far fewer texts than there are distinct words, and each word has its own ids."""
    one = token_planes.LibraryEncoder(WORD)
    sent, library = [], one.library

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **how)

    one.library = Counted()
    words = [f"{a}{b}{c}é" for a in "abcdefghijk" for b in "lmnopqrstuv" for c in "aeiou"]
    texts = [" ".join(words), "ıß ÿ Ĳx " + words[3] + ", 12 don't", *[t or "" for t in TEXTS]]
    got = one.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(sent) < len(words) / 2


def test_no_documents(spark, docs, tmp_path):
    none = docs.filter("doc_id < 0")
    token_planes.write(none, str(tmp_path / "none"), WORD, end_id=1)
    assert token_planes.read(spark, str(tmp_path / "none")).count() == 0
    assert bpe.encode(none, WORD).count() == token_counts.count_tokens(none, BYTE).count() == 0
