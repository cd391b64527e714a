"""Messages to graph commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.draws import integer_below, uniform
from tidegraph.functions.text import command_text, safe_label, words
from tidegraph.model import ADD_EDGE

# A follower page holds 5000 ids; made-up ids lie below 500 M.
PAGE_SIZE = 5000
ID_RANGE = 500_000_000

# Share of users (cumulative) and the bound their made-up
# follower count is drawn below.
FOLLOWER_BANDS = ((0.65, 2000), (0.90, 10000), (1.00, 50010))


def _involved() -> Column:
    empty = F.array().cast("array<bigint>")
    return F.concat(
        F.array(F.col("user.id")),
        F.coalesce("contributors", empty),
        F.coalesce("user_mentions.id", empty),
    )


def involved_users(tweets: DataFrame) -> DataFrame:
    """Add ``users``: the author, then contributors, then mentioned users.

    Absent lists count as empty; a user named twice stays twice.
    """
    return tweets.withColumn("users", _involved())


def user_roles(tweets: DataFrame) -> DataFrame:
    """``(id, position, user_id)``: one row per involved user, author at 0."""
    return involved_users(tweets).select(
        "id", F.posexplode("users").alias("position", "user_id")
    )


def mention_edges(tweets: DataFrame) -> DataFrame:
    """``addEdge`` commands from the author to every other involved user,
    labelled with the text as one token."""
    rest = F.slice("users", 2, F.size("users"))
    return involved_users(tweets).select(
        F.lit(ADD_EDGE).alias("op"),
        F.col("user.id").alias("src"),
        safe_label(F.col("text")).alias("attr"),
        F.explode(rest).alias("dst"),
    )


def mention_lines(tweets: DataFrame) -> DataFrame:
    """:func:`mention_edges` as text lines."""
    return mention_edges(tweets).select(command_text().alias("value"))


def made_up_follower_count(user: Column) -> Column:
    """A follower count fixed by the user id: most users have few."""
    share = uniform(user, salt="band")
    bound = F.lit(FOLLOWER_BANDS[-1][1])
    for upto, below in reversed(FOLLOWER_BANDS[:-1]):
        bound = F.when(share <= upto, below).otherwise(bound)
    return integer_below(bound, user, salt="followers")


def with_follower_ids(
    users: DataFrame,
    pages: DataFrame,
    user_col: str = "user_id",
    count_col: str = "n_followers",
) -> DataFrame:
    """Add ``follower_id``, one row per follower of each row's user.

    ``pages`` holds ``(user_id, ids)``, at most one page per user. A user
    without a page gets ``count_col`` made-up ids, always the same ones.

    The ids come by one many-to-one join and are unfolded only after it, so a
    user who writes a third of all messages is split like any hot join key.
    """
    listed = pages.select(F.col("user_id").alias(user_col), "ids")
    joined = users.join(listed, user_col, "left")
    numbers = F.when(
        F.col(count_col) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(count_col).cast("bigint") - 1)
    ).otherwise(F.array().cast("array<bigint>"))
    made_up = F.transform(
        numbers, lambda i: integer_below(ID_RANGE, F.col(user_col), i, salt="id")
    )
    return joined.select(
        *users.columns, F.explode(F.coalesce("ids", made_up)).alias("follower_id")
    )


def follower_edges(
    tweets: DataFrame, pages: DataFrame, author_limit: int | None = None
) -> DataFrame:
    """``addEdge`` commands from every involved user to each of their
    followers, labelled with the text as one token.

    Followers come from the user's page. Without a page they are made up: as
    many as the author's profile says, and a count fixed by the id for the other
    users. ``author_limit``, if the caller sets one (such as ``PAGE_SIZE``, the size
    of a page), bounds the made-up followers of an author.
    """
    profile = F.col("_profile")
    if author_limit is not None:
        profile = F.least(profile, F.lit(author_limit))
    roles = involved_users(tweets).select(
        safe_label(F.col("text")).alias("attr"),
        F.col("user.followers_count").cast("bigint").alias("_profile"),
        F.posexplode("users").alias("_position", "user_id"),
    )
    wanted = roles.select(
        "user_id",
        "attr",
        F.when(F.col("_position") == 0, profile)
        .otherwise(made_up_follower_count(F.col("user_id")))
        .alias("n_followers"),
    )
    return with_follower_ids(wanted, pages).select(
        F.lit(ADD_EDGE).alias("op"),
        F.col("user_id").alias("src"),
        "attr",
        F.col("follower_id").alias("dst"),
    )


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, count)`` over batch or streaming text; on a stream write it in
    update mode to keep publishing the running counts."""
    return (
        texts.select(F.explode(words(F.col(text_col))).alias("word"))
        .filter(F.col("word") != "")
        .groupBy("word")
        .agg(F.count("*").alias("count"))
    )


def count_messages(counts: DataFrame) -> DataFrame:
    """``word|count`` messages of word counts."""
    return counts.select(F.concat_ws("|", "word", F.col("count").cast("string")).alias("message"))


def latest_messages(published: DataFrame, message_col: str, number_col: str) -> DataFrame:
    """The newest message of each word among those of successive updates."""
    word = F.regexp_extract(message_col, r"^(.*)\|\d+$", 1)
    return published.groupBy(word.alias("word")).agg(
        F.max_by(message_col, number_col).alias("message")
    ).select("message")
