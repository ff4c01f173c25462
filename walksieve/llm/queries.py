"""The registered queries of this package with their production parameters, and SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard_join, licenses, lm, outliers, packing, pivot_search, repair, rule_ensemble, urlfilter, warc, whitening
from .common import fold, new_path, table

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, d, "documents"), coverage=0.8))


def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.revisits(table(spark, d, "pages")), path)
    read = warc.read(spark, path, verify="true")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, d, "documents"), ranks, public_tokenizers.PATTERN)


def op4_deleted_interpolation(spark: SparkSession, d: str) -> DataFrame:
    at = fold("doc_id", 5)
    part = F.when(at == 1, lm.SCORE_ONLY).when(at == 2, lm.FIT).otherwise(lm.TRAIN)
    scored = lm.score(table(spark, d, "documents"), part=part)
    return scored.select("doc_id", (F.col("part") == lm.SCORE_ONLY).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.join(table(spark, d, "documents"), k=3, percent=90)


def op6_url_cascade(spark: SparkSession, d: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, d, "pages"), URL_RULES)


def op7_pivot_top_k(spark: SparkSession, d: str) -> DataFrame:
    return pivot_search.top_k(table(spark, d, "embeddings"))


def op8_cutting_stock(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"), size=2048, end_id=1)


def op9_rule_ensemble(spark: SparkSession, d: str) -> DataFrame:
    scored = rule_ensemble.classify(table(spark, d, "documents"), table(spark, d, "labels"), fold("doc_id", 3) != 1)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "score", "predicted")


def op10_robust_outliers(spark: SparkSession, d: str) -> DataFrame:
    return outliers.judge(table(spark, d, "documents"))


def op11_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    conversations = table(spark, d, "conversations")
    rows = repair.damaged(conversations)
    return repair.digest(rows, repair.edits(rows), conversations)


def op12_spectrum_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"), components=8)


def op13_aho_corasick(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"), size=10))


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
SQL: dict[str, str] = {
    "op2_warc": """
with p as (select page_id, url, coalesce(html, '') as body from pages),
r as (select page_id, url, octet_length(encode(body)) as n, sha1(body) as digest from p),
f as (select digest, max(page_id) as first from r where n >= 1000 group by 1)
select page_id, n as payload_bytes, r.digest as payload_digest,
       case when n >= 1000 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> first then first end as refers_to, url
from r left join f on f.digest = r.digest""",
    "op7_pivot_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v::double[], c.v::double[]) as bigint) as score
      from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 20""",
    "op13_aho_corasick": r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as part
        from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
pos as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as part
        from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d join (select distinct n from win) on len(w) >= n)),
hit as (select rid, item_id, i, pos.n from pos join win on win.n = pos.n and win.part = pos.part),
h as (select rid, count(distinct place) as n_hit from (select rid, unnest(range(i, i + n)) as place from hit) group by 1),
m as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct rid, cast(item_id as varchar) as item from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       n_hit is not null as contaminated
from d left join h using (rid) left join m using (rid)""",
    "op6_url_cascade": f"""
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, regexp_extract(coalesce(rest, ''), '^([^?#]*)', 1) as bare from u),
s as (select page_id, translate(regexp_extract(bare, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             substr(bare, length(regexp_extract(bare, '^([^/]*)', 1)) + 1) as path from b),
r(verdict, h, p) as (values {_RULE_ROWS}),
m as (select s.page_id, max_by(r.h || r.p, length(r.h || r.p)) as rule, max_by(r.verdict, length(r.h || r.p)) as verdict
      from s join r on (s.host = r.h or ends_with(s.host, '.' || r.h)) and starts_with(s.path, r.p) group by 1)
select s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') as verdict from s left join m on m.page_id = s.page_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
