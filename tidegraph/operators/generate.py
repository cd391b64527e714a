"""Random commands for tests and load runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.draws import integer_below, uniform
from tidegraph.model import ADD_EDGE, ADD_NODE, EDGE_OPS, RMV_EDGE, RMV_NODE


@dataclass(frozen=True)
class Profile:
    """A mix of commands over a pool of ids; the shares add up to 1."""

    ids: int
    label: str
    add_edge: float
    add_node: float
    rmv_edge: float
    rmv_node: float


# The known mixes.
CHURN = Profile(5000, "dasd", 0.30, 0.20, 0.10, 0.40)
GROWTH = Profile(500_000, "Relation", 0.70, 0.10, 0.15, 0.05)
TINY = Profile(10, "dasd", 1.00, 0.00, 0.00, 0.00)


def random_commands(
    rows: DataFrame,
    key_col: str,
    profile: Profile,
    seed: int = 0,
    batch_size: int = 100_000,
) -> DataFrame:
    """One command ``(seq, batch_id, op, src, attr, dst)`` per key of ``rows``.

    Every draw is a hash of key and seed, so the commands do not change with
    partitioning, retries or streaming. ``batch_size`` keys make a batch.
    """
    key, salt = F.col(key_col), str(seed)
    share = uniform(key, salt="op" + salt)
    edge_or_node = profile.add_edge + profile.add_node
    op = (
        F.when(share <= profile.add_edge, ADD_EDGE)
        .when(share <= edge_or_node, ADD_NODE)
        .when(share <= edge_or_node + profile.rmv_edge, RMV_EDGE)
        .otherwise(RMV_NODE)
    )
    is_edge = F.col("op").isin(*EDGE_OPS)
    drawn = rows.select(
        key.alias("seq"),
        F.floor(key / batch_size).alias("batch_id"),
        op.alias("op"),
        integer_below(profile.ids, key, salt="src" + salt).alias("src"),
        integer_below(profile.ids, key, salt="dst" + salt).alias("_dst"),
    )
    return drawn.select(
        "seq",
        "batch_id",
        "op",
        "src",
        F.when(is_edge, profile.label).alias("attr"),
        F.when(is_edge, F.col("_dst")).alias("dst"),
    )


def generate(
    spark: SparkSession, n: int, profile: Profile, seed: int = 0, batch_size: int = 100_000
) -> DataFrame:
    """``n`` random commands."""
    return random_commands(spark.range(n), "id", profile, seed, batch_size)


def generate_stream(
    spark: SparkSession,
    rows_per_second: int,
    profile: Profile,
    seed: int = 0,
    batch_size: int = 100_000,
) -> DataFrame:
    """An endless stream of random commands."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return random_commands(ticks, "value", profile, seed, batch_size)


def mix_report(commands: DataFrame, profile: Profile, tolerance: float) -> DataFrame:
    """``(op, expected, within)`` per kind: is its share as the profile says?"""
    expected = [
        (ADD_EDGE, profile.add_edge),
        (ADD_NODE, profile.add_node),
        (RMV_EDGE, profile.rmv_edge),
        (RMV_NODE, profile.rmv_node),
    ]
    tally = commands.agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("op") == op).alias(op) for op, _ in expected],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(op).alias("op"),
                F.lit(share).alias("expected"),
                (F.abs(F.col(op) / F.col("_n") - share) <= tolerance).alias("within"),
            )
            for op, share in expected
        ]
    )
    return tally.select(F.inline(rows))
