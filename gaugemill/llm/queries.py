"""The queries ``opN_<name>``: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm import bpe, collocations, conversations, host_rules, html_crf, jaccard, multiset_hash, phrase_index, pii, quality, token_counts, token_planes, warc
from gaugemill.llm.common import scratch

#: The operators' production parameters.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "planes")
    token_planes.write(table(spark, sf_dir, "documents"), folder, WORD_BPE, end_id=1)
    return token_planes.read(spark, folder)


def op2_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_crf.extract(pages, html_crf.train(pages))


def op3_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, limit=512)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    return quality.score(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = multiset_hash.with_next(table(spark, sf_dir, "documents"))
    return marks.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), support=30, top=2000)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_html_crf": op2_html_crf,
    "op3_phrase_index": op3_phrase_index,
    "op4_jaccard": op4_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_multiset_hash": op8_multiset_hash,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_collocations": op11_collocations,
    "op12_conversations": op12_conversations,
    "op13_host_rules": op13_host_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op3_phrase_index": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
i AS (SELECT cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w),10) k, array_to_string(w[p:p+least(len(w),10)-1],' ') g FROM (SELECT item_id, w, unnest(range(1, len(w)-least(len(w),10)+2)) p FROM i WHERE len(w)>0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p+k-1],' ') g FROM (SELECT doc_id, w, k, unnest(range(1, len(w)-k+2)) p FROM d, ks WHERE len(w)>=k)),
m AS (SELECT DISTINCT doc_id, dw.k, p, item_id FROM dw JOIN iw ON dw.g=iw.g AND dw.k=iw.k),
h AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(range(p,p+k)) q FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit,0)::BIGINT n_hit, coalesce(n_items,0)::BIGINT n_items, sha256(coalesce(s,'')) items_sha256, coalesce(n_hit,0)>0 contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op4_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+least(len(w),3)-1],' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)-1))) p FROM w WHERE len(w)>0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*c >= 90*(x.n+y.n-c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b=e.a)
SELECT w.doc_id, coalesce(n,0)::BIGINT n_shingles, m.m component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a doc_id, min(b) m FROM r GROUP BY 1) m USING (doc_id)
""",
    "op9_warc": r"""
WITH p AS (SELECT page_id, coalesce(html,'') h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT payload_bytes, sha1(h) x, min(page_id) OVER (PARTITION BY sha1(h)) first FROM p)
SELECT page_id, payload_bytes,
 (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || x[10*g+1:10*g+10])::BIGINT >> (35 - 5*i)) & 31)], '' ORDER BY g, i) FROM range(4) a(g), range(8) b(i)) payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type,
 CASE WHEN page_id <> first THEN first END refers_to
FROM d
""",
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang,'und') lang, translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') t FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT n FROM w GROUP BY 1),
f AS (SELECT lang, k, array_to_string(w[i:i+k-1],' ') phrase, count(*) a FROM (SELECT lang, w, unnest(range(1, len(w)+1)) i FROM w WHERE len(w)>0), (VALUES (1),(2),(3),(4)) v(k) WHERE i+k-1<=len(w) GROUP BY 1,2,3 HAVING count(*)>=30),
c AS (SELECT lang, phrase, k, a, string_split(phrase,' ') w, unnest(range(1, k)) j FROM f WHERE k>1),
s AS (SELECT c.lang, c.phrase, c.a, x.a l, y.a r, ((2000000*c.a::HUGEINT)//(x.a+y.a))::BIGINT score, j FROM c JOIN f x ON x.lang=c.lang AND x.phrase=array_to_string(c.w[1:j],' ') JOIN f y ON y.lang=c.lang AND y.phrase=array_to_string(c.w[j+1:c.k],' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j)=1),
i AS (SELECT lang, array_to_string(w[p:p+m-1],' ') phrase, max(a) most FROM (SELECT lang, w, k, a, m, unnest(range(1, k-m+2)) p FROM (SELECT DISTINCT lang, w, k, a FROM c), (VALUES (2),(3)) v(m) WHERE m<k) GROUP BY 1,2),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang=b.lang AND i.phrase=b.phrase WHERE most IS NULL OR 100*most < 80*a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT rank FROM o) JOIN n USING (lang) WHERE rank<=2000
""",
    "op12_conversations": r"""
WITH RECURSIVE t(c) AS (SELECT list(list_reduce([x,0,0,0,0,0,0,0,0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY x) FROM (SELECT unnest(range(256)) x)),
raw AS (SELECT conv_id, turn, coalesce(role,' ') role, coalesce(text,' ') text, encode(coalesce(conv_id::VARCHAR,' ')||':'||coalesce(turn::VARCHAR,' ')) key FROM conversations),
crc AS (SELECT raw.* EXCLUDE key, xor(4294967295, list_reduce(list_prepend(4294967295, [('0x'||substr(hex(key), 2*i+1, 2))::BIGINT for i in range(octet_length(key))]), lambda a, b: xor(a >> 8, c[1+(xor(a, b) & 255)]))) % 20 f FROM raw, t),
dam AS (SELECT conv_id, turn, CASE WHEN f=4 THEN 'user' ELSE role END role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text,'.!?','') ELSE text END text, unnest(CASE WHEN f=3 THEN [0,1] ELSE [0] END) FROM crc WHERE f<>0),
num AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) i, rtrim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) bare FROM dam),
r AS (SELECT * EXCLUDE seen, CASE WHEN bare='' THEN 'b' WHEN seen>1 THEN 'd' WHEN right(bare,1) NOT IN ('.','!','?') THEN 't' ELSE '' END fault, substr(role,1,1) x, lag(substr(role,1,1)) OVER (PARTITION BY conv_id ORDER BY i) was FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) seen FROM num)),
conv AS (SELECT DISTINCT conv_id FROM conversations),
figures AS (SELECT conv_id, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn), 0) gaps, count(*) FILTER (fault='b') blank, count(*) FILTER (fault='d') duplicate, count(*) FILTER (fault='t') truncated, count(*) FILTER (was IS NOT NULL AND was||x NOT IN ('su','ua','au')) illegal, count(*) n FROM r GROUP BY 1),
go(q, p, to_q, cost, ins, extra) AS (VALUES (0,0,0,0,'',''),(0,1,2,2,'I','user:'||chr(10)),(0,2,3,4,'II','user:'||chr(10)||'assistant:'||chr(10)),(1,0,1,0,'',''),(1,1,2,2,'I','user:'||chr(10)),(1,2,3,4,'II','user:'||chr(10)||'assistant:'||chr(10)),(2,0,2,0,'',''),(2,1,3,2,'I','assistant:'||chr(10)),(2,2,2,4,'II','assistant:'||chr(10)||'user:'||chr(10)),(3,0,3,0,'',''),(3,1,2,2,'I','user:'||chr(10)),(3,2,3,4,'II','user:'||chr(10)||'assistant:'||chr(10))),
st(conv_id, i, q, cost, audit, out) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', '' FROM conv
  UNION ALL
  SELECT conv_id, i, q, cost, audit, out FROM (
    SELECT st.conv_id, r.i, CASE e.e WHEN 'D' THEN go.to_q WHEN 'R' THEN CASE go.to_q WHEN 2 THEN 3 ELSE 2 END ELSE CASE WHEN r.x='' THEN go.to_q WHEN go.to_q=0 AND r.x='s' THEN 1 WHEN go.to_q<>2 AND r.x='u' THEN 2 WHEN go.to_q=2 AND r.x='a' THEN 3 END END q,
      st.cost + go.cost + CASE e.e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.e<>'D' AND r.fault='t' THEN 1 ELSE 0 END AS cost, st.audit||go.ins||e.e AS audit,
      st.out||go.extra||CASE e.e WHEN 'D' THEN '' WHEN 'K' THEN r.role||':'||r.text||chr(10) ELSE CASE go.to_q WHEN 2 THEN 'assistant' ELSE 'user' END||':'||r.text||chr(10) END AS out
    FROM st JOIN r ON r.conv_id IS NOT DISTINCT FROM st.conv_id AND r.i=st.i+1 JOIN go ON go.q=st.q, (VALUES ('D'),('K'),('R')) e(e) WHERE e.e='D' OR r.fault NOT IN ('b','d'))
  WHERE q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit)=1),
fin AS (SELECT st.conv_id, st.cost+go.cost AS cost, st.audit||go.ins AS audit, st.out||go.extra AS out FROM st JOIN go ON go.q=st.q LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM st.conv_id WHERE st.i=coalesce(f.n,0) AND go.to_q IN (0,3) QUALIFY row_number() OVER (PARTITION BY st.conv_id ORDER BY st.cost+go.cost, st.audit||go.ins)=1)
SELECT fin.conv_id, coalesce(gaps,0)::BIGINT gaps, coalesce(blank,0)::BIGINT blank, coalesce(duplicate,0)::BIGINT duplicate, coalesce(truncated,0)::BIGINT truncated, coalesce(illegal,0)::BIGINT illegal, cost::BIGINT AS cost, audit, sha256(left(out, length(out)-1)) repaired_sha256 FROM fin LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM fin.conv_id
""",
    "op13_host_rules": r"""
WITH d AS (SELECT row_number() OVER () i, doc_id, source, coalesce(text,'') t, list_filter(regexp_split_to_array(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w, list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM documents),
g AS (SELECT i, p, count(*) OVER (PARTITION BY i, s) c FROM (SELECT i, p, array_to_string(w[p:p+7],' ') s FROM (SELECT i, w, unnest(range(1, len(w)-6)) p FROM d WHERE len(w)>8))),
v AS (SELECT i, count(DISTINCT q) n FROM (SELECT i, unnest(range(p, p+8)) q FROM g WHERE c>1) GROUP BY 1),
m AS (SELECT d.i, doc_id, CASE WHEN regexp_matches(source, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)') THEN regexp_replace(lower(regexp_extract(source, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') ELSE source END host,
  len(w)::BIGINT n_words, length(array_to_string(w,''))::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, len(ls)::BIGINT n_lines, (len(ls)-len(list_distinct(ls)))::BIGINT n_dup_lines, coalesce(n,0)::BIGINT n_repeat_words FROM d LEFT JOIN v USING (i)),
e AS (SELECT host, unnest(['few words','repeated','symbols','repeated lines']) rule, unnest([n_words<20, 100*n_repeat_words>30*n_words, 10*n_symbols>word_chars, 2*n_dup_lines>n_lines]) bad FROM m WHERE host IS NOT NULL),
h AS (SELECT host, rule, count(*) n, count(*) FILTER (bad) k FROM e GROUP BY 1,2),
s AS (SELECT rule, count(*)::DOUBLE hosts, sum(n)::DOUBLE al, sum(k)::DOUBLE/sum(n) mean, sum(n::DOUBLE*n) sq, sum(k::DOUBLE*k/n) sp FROM h GROUP BY 1),
u AS (SELECT rule, mean, (((sp-al*mean*mean)/nullif(mean*(1-mean),0)) - (hosts-1)) / nullif(al-sq/al-(hosts-1),0) x FROM s),
pr AS (SELECT rule, mean, CASE WHEN x>0 THEN least(greatest(1/x-1, 1), 10000) ELSE 10000 END z FROM u),
bad AS (SELECT DISTINCT host FROM h JOIN pr USING (rule) WHERE (k+mean*z)/(n+z) >= 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words<20 OR 100*n_repeat_words>30*n_words base_failed, NOT (n_words<20 OR 100*n_repeat_words>30*n_words) AND bad.host IS NULL kept FROM m LEFT JOIN bad USING (host)
""",
}
