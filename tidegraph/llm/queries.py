"""The registered queries of this subpackage and the SQL of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import (
    alignment,
    decontamination,
    html,
    language,
    lexical,
    mixing,
    near_dedup,
    packing,
    pii,
    quality,
    urls,
    vectors,
    warc,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as place
  from documents),
totals as (
  select source, cast(sum(size) as bigint) as source_size,
    (array[5.0::double, 2.0::double, 1.0::double])[
      1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sized group by source),
capped as (
  select *, cast(3 * source_size as double) as cap,
    (sum(source_size) over () - coalesce(sum(3.0::double * source_size) over (
       order by 3 * source_size / weight, source nulls last
       rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by 3 * source_size / weight, source nulls last
       rows between current row and unbounded following) as level
  from totals),
goal as (
  select source, source_size, least(cap, weight * coalesce((
    select arg_min(level, cap / weight) from capped where level * weight <= cap), 0)) as target
  from capped),
budgets as (
  select *, cast(coalesce(floor(target / nullif(source_size, 0)), 0) as bigint) as times,
    cast(round(target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size) as bigint)
      as budget
  from goal),
placed as (
  select s.*, b.source_size, b.target, b.times, b.budget,
    coalesce(sum(s.size) over (partition by s.source order by s.place
      range between unbounded preceding and current row), 0) as upto,
    sum(s.size) over (partition by s.source, s.place) as there
  from sized s join budgets b on s.source is not distinct from b.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(times * size + case when upto <= budget then size
    when upto - there > budget then 0
    else (budget - (upto - there)) * size // nullif(there, 0) end as bigint) as taken
from placed"""


@_query(MIX_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query()
def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query()
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


@_query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


WARC_SQL = """
with payloads as (
  select page_id, coalesce(encode(html), ''::blob) as payload from pages),
digested as (
  select page_id, octet_length(payload) as n, sha1(payload) as digest,
    min(page_id) over (partition by sha1(payload)) as first_id
  from payloads)
select page_id, cast(n as bigint) as payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 +
     ((('0x' || substr(digest, 1 + 10 * g, 10))::bigint >> (35 - 5 * i)) & 31) as int), 1), ''
     order by g, i) from range(4) a(g), range(8) b(i)) as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from digested"""


@_query(WARC_SQL)
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@_query()
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages")).drop("confidence")


@_query()
def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


@_query()
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


@_query()
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


@_query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(_table(spark, sf_dir, "documents"))


CONTAMINATION_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (
  select distinct item_id, least(len(w), 10) as k,
    array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
grams as (
  select r, i, k, array_to_string(w[i : i + k - 1], ' ') as s
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i
        from d, (select distinct k from wins) where len(w) >= k)),
hits as (select r, i, k, s from grams where s in (select s from wins)),
words as (select r, count(distinct p) as n_hit
  from (select r, unnest(range(i, i + k)) as p from hits) group by r),
items as (
  select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct r, item_id from hits join wins using (s)) where item_id is not null group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)"""


@_query(CONTAMINATION_SQL)
def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


SEARCH_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (
  select distinct row_number() over () as q, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
totals as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as n_terms from d where len(w) > 0),
postings as (
  select r, term, count(*) as tf
  from (select r, unnest(w) as term from d) where term in (select term from q) group by r, term),
weights as (
  select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1))) as bigint) as weight
  from postings, totals group by term),
scored as (
  select q, item_id, r, doc_id, cast(sum(weight * ((1000000000 * tf)
    // (1000 * tf + 8 * (10 + (90 * len(w) * n_docs) // n_terms)))) as bigint) as score
  from q join postings using (term) join weights using (term) join d using (r), totals
  group by q, item_id, r, doc_id),
ranked as (
  select item_id, row_number() over (partition by q order by score desc, doc_id nulls last) as rank,
    doc_id, score from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10"""


@_query(SEARCH_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
