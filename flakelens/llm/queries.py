"""Registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flakelens.llm import (
    collocations,
    decontamination,
    exact_dedup,
    html_text,
    lexical_search,
    near_dedup,
    packing,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    url_filter,
)
from flakelens.llm.common import table

SHARDS = 8
RULES = [  # host, path, action
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, per_cent=85)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_windows(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), top=2000, least=100)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=2)


OP2_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""

OP8_SQL = r"""
with p as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from p),
u as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
  from h),
rules(rhost, rpath, action) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (
  select page_id, host, path,
         (select max(lpad(length(rhost || rpath)::varchar, 6, '0') || '|' || rhost || rpath || '|' || action)
          from rules
          where (u.host = rhost or ends_with(u.host, '.' || rhost)) and starts_with(u.path, rpath)) as b
  from u)
select page_id, host, path, case when b is not null then split_part(b, '|', 2) end as rule,
       case when b is null then 'allow' else split_part(b, '|', 3) end as verdict
from best
"""

OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from cut group by lang),
grams as (
  select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i
        from cut, (select unnest(range(1, 6)) as k))),
often as (
  select lang, k, phrase, string_split(phrase, ' ') as ws, count(*) as f
  from grams group by all having count(*) >= 100),
cuts as (
  select o.lang, o.phrase, o.f as a, o.c, x.f as l, y.f as r,
         (1000::hugeint * o.f * n // (x.f::hugeint * y.f))::bigint as score, n
  from (select *, unnest(range(1, k)) as c from often where k > 1) o
  join totals using (lang)
  join often x on x.lang = o.lang and x.k = o.c and x.phrase = array_to_string(o.ws[1:o.c], ' ')
  join often y on y.lang = o.lang and y.k = o.k - o.c and y.phrase = array_to_string(o.ws[o.c + 1:], ' ')),
scored as (
  select lang, phrase, a, n, min(score) as score, arg_min(struct_pack(l := l, r := r), (score, c)) as lr
  from cuts group by lang, phrase, a, n),
inner_parts as (
  select lang, max(f) as longer, part
  from (select lang, f, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:], ' ')]) as part
        from often where k > 2)
  group by lang, part)
select s.lang, (row_number() over (partition by s.lang order by score desc, a desc, s.phrase))::int as rank,
       s.phrase, a, lr.l as l, lr.r as r, n, score
from scored s left join inner_parts i on i.lang = s.lang and i.part = s.phrase
where longer is null or longer < a
qualify rank <= 2000
"""

OP12_SQL = r"""
with lowered as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
postings as (
  select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from lowered) group by all),
lengths as (select doc_id, len(terms)::bigint as n from lowered where len(terms) > 0),
totals as (select count(*)::bigint as docs, sum(n)::bigint as words from lengths),
asked as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*) as df from postings group by term), totals),
scored as (
  select item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::bigint as score
  from asked join weights using (term) join postings using (term) join lengths using (doc_id), totals
  group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 50
"""

QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_exact_dedup": (op2_exact_dedup, OP2_SQL),
    "op3_sharding": (op3_sharding, None),
    "op4_quality": (op4_quality, None),
    "op5_minhash": (op5_minhash, None),
    "op6_html_text": (op6_html_text, None),
    "op7_decontamination": (op7_decontamination, None),
    "op8_url_filter": (op8_url_filter, OP8_SQL),
    "op9_substring_dedup": (op9_substring_dedup, None),
    "op10_packing": (op10_packing, None),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_lexical_search": (op12_lexical_search, OP12_SQL),
    "op13_simhash": (op13_simhash, None),
}
