"""Social messages as JSON, and pages of follower ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The parts of a message that are used.
TWEET_SCHEMA = (
    "id bigint, user struct<id:bigint,followers_count:int>, text string, "
    "contributors array<bigint>, user_mentions array<struct<id:bigint>>"
)
FOLLOWER_PAGE_SCHEMA = "ids array<string>"


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Messages from JSON-lines files."""
    return spark.read.schema(TWEET_SCHEMA).json(path)


def stream_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Messages from JSON-lines files as they arrive."""
    return spark.readStream.schema(TWEET_SCHEMA).json(path)


def parse_tweets(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Messages from JSON text of any source, batch or stream."""
    return lines.select(F.from_json(value_col, TWEET_SCHEMA).alias("t")).select("t.*")


def page_ids(page: Column) -> Column:
    """The ids listed in one JSON follower page; entries that are no number
    are skipped, and a page without a list gives null."""
    ids = F.from_json(page, FOLLOWER_PAGE_SCHEMA)["ids"]
    return F.filter(
        F.transform(ids, lambda i: i.try_cast("bigint")), lambda i: i.isNotNull()
    )
