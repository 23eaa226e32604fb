"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontam, hilbert, jaccard, langid, lattice, packing, quality, suffix, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int, name: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(name).cast("string")), F.lit(parts))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_read(spark, sf_dir, "pages")), "page_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = langid.predict(docs, langid.fit(docs, _fold(4) != 2))
    return rows.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(suffix.repeated_bytes(_read(spark, sf_dir, "documents"), 100)).drop("kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lattice.score(_read(spark, sf_dir, "documents"), _fold(10) != 0)
    return rows.select("doc_id", (_fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels"), _fold(3) != 1))
    return rows.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_matches")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), 3, 90, 100)


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_lattice_likelihood": op7_lattice_likelihood,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_hilbert_neighbours": op10_hilbert_neighbours,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op6_decontamination": f"""
with d as (select doc_id, {_WORDS} w from documents), b as (select item_id, {_WORDS} w from benchmark),
bw as (select distinct item_id, least(len(w), 10) m, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') run
       from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) s from b where len(w) > 0)),
ms as (select distinct m from bw),
dw as (select doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') run
       from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) s from d, ms where len(w) >= m)),
hit as (select doc_id, s, m, item_id from dw join bw using (m, run)),
pos as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(s, s + m)) p from hit) group by doc_id),
it as (select doc_id, count(*) n, sha256(string_agg(item_id::varchar, ',' order by item_id::varchar)) h
       from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(pos.n, 0)::bigint n_hit, coalesce(it.n, 0)::bigint n_items,
       coalesce(it.h, sha256('')) items_sha256, coalesce(pos.n, 0) > 0 contaminated
from d left join pos on d.doc_id = pos.doc_id left join it on d.doc_id = it.doc_id""",
    "op9_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
r as (select doc_id id, doc_id top from w union select l.b, r.top from r join l on l.a = r.id)
select doc_id, coalesce(n, 0)::bigint n_shingles, m component_id from w left join n using (doc_id) join (select id doc_id, min(top) m from r group by 1) using (doc_id)""",
}


def _warc_sql() -> str:
    def urn(x: str) -> str:
        h = f"sha1({x})"
        return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"
    refs = ", ".join(f"({quoted(name)}, {quoted(sign)})" for name, sign in html5.items())
    named = "|".join(sorted(html5, key=lambda name: (-len(name), name)))  # the longest name that fits
    text = r"""regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->', ' ', 'g')"""
    text = rf"""regexp_replace({text}, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre)\b[^>]*>', chr(10), 'g')"""
    text = f"""regexp_replace({text}, '<[^>]*>', ' ', 'g')"""
    folded = r"""regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\x{a0}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""
    return rf"""
with p as (select page_id, coalesce(url, '') url, coalesce(html, '') html from pages),
h as (select *, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) || {crlf} || {crlf} source_headers, 'sha1:' || sha1(html) source_payload_digest,
 {urn("concat_ws(chr(10), 'response', page_id::varchar, url)")} refers_to from p),
c as (select *, 'sha1:' || sha1(source_headers || html) source_block_digest, row_number() over () as r from h),
refs(name, sign) as (values {refs}),
raw as (select r, 'text' part, 0 n, {text} t from c union all select r, 'title', 0, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) from c
 union all select r, 'link', n, regexp_replace(x, '^["'']|["'']$', '', 'g') from (select r, unnest(l) x, generate_subscripts(l, 1) n from (select r, regexp_extract_all(html, {quoted(warc.LINK)}, 1) l from c))),
pieces as (select r, part, n, i, x, case when i > 1 then regexp_extract(x, '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|{named})') else '' end ref
 from (select r, part, n, unnest(string_split(t, '&')) x, generate_subscripts(string_split(t, '&'), 1) i from raw)),
codes as (select *, case when ref[:1] <> '#' then null when lower(ref[2:2]) = 'x' then ('0x' || rtrim(ref[3:], ';'))::bigint else rtrim(ref[2:], ';')::bigint end code from pieces),
whole as (select r, part, n, string_agg(case when i = 1 then x when ref = '' then '&' || x
   else coalesce(case when code = 0 or code > 1114111 or code between 55296 and 57343 then chr(65533) when code is not null then chr(code::int) end, sign) || x[length(ref) + 1:] end, '' order by i) t
 from codes left join refs on name = ref group by r, part, n),
content as (select r, max({folded}) filter (part = 'text') body, max(trim(regexp_replace(t, '[ \t\r\n\f\x{{a0}}]+', ' ', 'g'))) filter (part = 'title') title,
 coalesce(string_agg('outlink: ' || regexp_replace(t, '[\t\r\n]', '', 'g') || {crlf}, '' order by n) filter (part = 'link'), '') links from whole group by r),
k as (select *, 'metadata' record_type, 'application/warc-fields' content_type, 'source-status: 200' || {crlf} || 'source-payload-digest: ' || source_payload_digest || {crlf} || 'source-content-length: ' || strlen(html) || {crlf}
  || 'title: ' || title || {crlf} || links content from c join content using (r)
 union all select *, 'conversion', 'text/plain; charset=utf-8', body from c join content using (r))
select page_id, record_type, {urn("concat_ws(chr(10), record_type, refers_to)")} record_id, refers_to, url refers_to_target_uri, '2026-01-01T00:00:00Z' refers_to_date, content_type, source_headers, source_payload_digest, source_block_digest,
 'sha1:' || sha1(content) block_digest, strlen(content)::bigint content_length, content from k"""


ORACLE["op1_warc_derivatives"] = _warc_sql()
