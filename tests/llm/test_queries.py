"""The registered ``opN_`` queries themselves, with production parameters on a whole table, against the libraries and brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gaugemill.llm import queries
from gaugemill.llm.multiset_hash import Fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_planes": "doc_id start n_tokens ids_crc32",
    "op2_html_crf": "page_id url text n_chars",
    "op3_phrase_index": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_jaccard": "doc_id n_shingles component_id",
    "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_quality": "doc_id held_out score predicted",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_multiset_hash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_collocations": "lang rank phrase a l r n score",
    "op12_conversations": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_host_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name: queries.QUERIES[name](spark, SF).collect() for name in ("op1_token_planes", "op5_token_counts", "op6_quality", "op8_multiset_hash", "op10_bpe")}


def test_names():
    assert list(COLUMNS) == list(queries.QUERIES)


@pytest.mark.parametrize("name", ["op2_html_crf", "op3_phrase_index", "op7_pii", "op9_warc", "op11_collocations", "op12_conversations", "op13_host_rules"])
def test_columns(spark, name):
    assert set(COLUMNS[name].split()) <= set(queries.QUERIES[name](spark, SF).columns)


def test_tokens(texts, results):
    word, byte = Tokenizer.from_file(queries.WORD_BPE), Tokenizer.from_file(queries.BYTE_BPE)
    planes, counts, bpe = ({r["doc_id"]: r for r in results[n]} for n in ("op1_token_planes", "op5_token_counts", "op10_bpe"))
    assert planes.keys() == counts.keys() == bpe.keys() == texts.keys()
    start = 0
    for i in sorted(texts):
        ids = word.encode(texts[i], add_special_tokens=False).ids
        raw = np.array([*ids, 1], "<u4").tobytes()
        assert (planes[i]["start"], planes[i]["n_tokens"], planes[i]["ids_crc32"]) == (start, len(ids) + 1, zlib.crc32(raw))
        start += len(ids) + 1
        assert (bpe[i]["n_tokens"], bpe[i]["ids_sha256"]) == (len(ids), hashlib.sha256(raw[:-4]).hexdigest())
        assert bpe[i]["decoded_sha256"] == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        n = len(byte.encode(texts[i], add_special_tokens=False).ids)
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len(texts[i].encode()), n, n > 512)


def test_scores(texts, results):
    for r in results["op6_quality"]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert len(results["op6_quality"]) == len(texts)


def test_fingerprints(texts, results):
    rows, order = {r["doc_id"]: r for r in results["op8_multiset_hash"]}, sorted(texts, reverse=True)
    mark = lambda text: Fingerprint.read(bytes.fromhex(text))
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        third = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - third] + texts[after][:third]
        assert rows[i]["n_chars"] == len(texts[i]) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert bytes.fromhex(rows[i]["fingerprint"]) == bytes(Fingerprint.of(texts[i])) and bytes.fromhex(rows[i]["edited_fingerprint"]) == bytes(Fingerprint.of(edited))
        assert rows[i]["near_edited"] == mark(rows[i]["fingerprint"]).likeness(mark(rows[i]["edited_fingerprint"]))
        assert rows[i]["near_next"] == mark(rows[i]["fingerprint"]).likeness(mark(rows[after]["fingerprint"]))
