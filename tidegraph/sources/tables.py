"""Views of the star-schema tables as commands, messages and follower pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.model import ADD_EDGE, ADD_NODE, RMV_EDGE, RMV_NODE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_commands(events: DataFrame) -> DataFrame:
    """Events as commands: visits add edges from users to pages, signups add
    users, errors remove an edge or a user. A thousand events are a batch."""
    event_type, event_id = F.col("event_type"), F.col("event_id")
    visit = event_type.isin("click", "view", "purchase")
    undo = (event_type == "error") & (event_id % 10 != 0)
    undone = (
        F.when(event_id % 3 == 0, "click").when(event_id % 3 == 1, "view").otherwise("purchase")
    )
    return events.select(
        event_id.alias("seq"),
        F.expr("event_id div 1000").alias("batch_id"),
        "ts",
        F.when(visit, ADD_EDGE)
        .when(event_type == "signup", ADD_NODE)
        .when(event_id % 10 == 0, RMV_NODE)
        .otherwise(RMV_EDGE)
        .alias("op"),
        F.col("user_id").alias("src"),
        F.when(visit, event_type).when(undo, undone).alias("attr"),
        F.when(visit | undo, F.regexp_extract("props", r"(\d+)", 1).cast("bigint")).alias("dst"),
    )


def event_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`as_commands` of the ``events`` table."""
    return as_commands(table(spark, sf_dir, "events"))


def order_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as messages: a customer writes to a supplier, returned
    parts appear as contributors, the priority is the text."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"
    )
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.struct(
            F.col("o_custkey").alias("id"), F.col("l_linenumber").alias("followers_count")
        ).alias("user"),
        F.concat_ws("\n", "o_orderpriority", "o_orderstatus").alias("text"),
        F.when(F.col("l_returnflag") == "R", F.array("l_partkey")).alias("contributors"),
        F.array(F.struct(F.col("l_suppkey").alias("id"))).alias("user_mentions"),
    )


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, value)``: a JSON follower page per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.format_string(
            '{"ids":[%d,%d,"%s",%d],"next_cursor":0}',
            F.col("c_custkey") + 1,
            F.col("c_nationkey").cast("bigint"),
            F.col("c_mktsegment"),
            F.col("c_custkey") + 7,
        ).alias("value"),
    )
