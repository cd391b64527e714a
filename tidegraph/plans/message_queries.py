"""Queries on messages, followers and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.text import safe_label
from tidegraph.operators import tweets as ops
from tidegraph.plans.catalog import query
from tidegraph.plans.sql import ctes
from tidegraph.sources.tables import customer_pages, order_tweets, table
from tidegraph.sources.tweets import page_ids, parse_tweets

_TWEETS = """tweets as (
  select l_orderkey * 10 + l_linenumber as id, o_custkey as author,
    o_orderpriority || chr(10) || o_orderstatus as text,
    case when l_returnflag = 'R' then [l_partkey] else [] end as contributors,
    [l_suppkey] as mentions
  from lineitem join orders on l_orderkey = o_orderkey)"""
_ROLES = """roles as (
  select id, text, author, unnest([author] || contributors || mentions) as user_id,
    unnest(range(2 + len(contributors))) as position from tweets)"""
_LABEL = "replace(replace(replace(text, ' ', '_'), chr(10), ''), chr(13), '')"


@query(ctes(_TWEETS, _ROLES) + "select id, cast(position as int) as position, user_id from roles")
def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.user_roles(order_tweets(spark, sf_dir))


@query(ctes(_TWEETS, _ROLES) + "select id, cast(position as int) as position, user_id from roles")
def tweets_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = order_tweets(spark, sf_dir)
    lines = tweets.select(F.to_json(F.struct(*tweets.columns)).alias("value"))
    return ops.user_roles(parse_tweets(lines))


@query(
    ctes(_TWEETS, _ROLES)
    + f"select 'addEdge' as op, author as src, {_LABEL} as attr, user_id as dst from roles where position > 0"
)
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mention_edges(order_tweets(spark, sf_dir))


@query(
    ctes(_TWEETS, _ROLES)
    + f"select 'addEdge ' || author || ' ' || {_LABEL} || ' ' || user_id as value from roles where position > 0"
)
def mention_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mention_lines(order_tweets(spark, sf_dir))


@query(f"select conv_id, turn, {_LABEL} as label from conversations")
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", safe_label(F.col("text")).alias("label")
    )


@query(
    """select c_custkey as user_id, unnest([c_custkey + 1, cast(c_nationkey as bigint), c_custkey + 7])
  as follower_id from customer"""
)
def follower_page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_pages(spark, sf_dir).select(
        "user_id", F.explode(page_ids(F.col("value"))).alias("follower_id")
    )


def _part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every user of :func:`order_tweets`: part keys cover them."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("user_id"), F.array(key + 1, F.col("p_size").cast("bigint")).alias("ids")
    )


@query(
    ctes(_TWEETS, _ROLES)
    + f"""select 'addEdge' as op, user_id as src, {_LABEL} as attr,
  unnest([p_partkey + 1, cast(p_size as bigint)]) as dst
from roles join part on p_partkey = user_id"""
)
def follower_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.follower_edges(order_tweets(spark, sf_dir), _part_pages(spark, sf_dir))


@query(
    """select c_custkey as user_id,
  cast(case when c_custkey in (select o_custkey from orders) then 3 else c_nationkey end as bigint) as n,
  true as plausible
from customer
where c_custkey in (select o_custkey from orders) or c_nationkey > 0"""
)
def follower_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    pages = (
        customer_pages(spark, sf_dir)
        .join(buyers, "user_id", "left_semi")
        .select("user_id", page_ids(F.col("value")).alias("ids"))
    )
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_followers")
    )
    ids = ops.with_follower_ids(users, pages)
    return ids.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("follower_id").between(0, ops.ID_RANGE - 1)).alias("plausible"),
    )


@query(
    """select cast(count(distinct o_custkey) as bigint) as n_users, true as in_range, true as mostly_small,
  true as fixed_by_user from orders"""
)
def made_up_follower_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = table(spark, sf_dir, "orders").select(
        "o_custkey", ops.made_up_follower_count(F.col("o_custkey")).alias("n")
    )
    per_user = drawn.groupBy("o_custkey").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # 0.65 + 0.25 * 2000 / 10000 + 0.10 * 2000 / 50010 of the users are below 2000.
    small = F.count_if(F.col("low") < 2000) / F.count("*")
    return per_user.agg(
        F.count("*").alias("n_users"),
        F.bool_and(F.col("low").between(0, 50009)).alias("in_range"),
        (F.abs(small - 0.704) < 0.06).alias("mostly_small"),
        F.bool_and(F.col("low") == F.col("high")).alias("fixed_by_user"),
    )


_WORDS = r"""words as (
  select word, count(*) as n from (
    select unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) as word from documents)
  where word <> '' group by word)"""


@query(ctes(_WORDS) + 'select word, cast(n as bigint) as "count" from words')
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.word_counts(table(spark, sf_dir, "documents"))


@query(ctes(_WORDS) + "select word || '|' || n as message from words")
def count_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.count_messages(ops.word_counts(table(spark, sf_dir, "documents")))
