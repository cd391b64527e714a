"""Edge expiry: edges not added again within a time to live are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.times import epoch_micros, micros_to_timestamp
from tidegraph.model import ADD_EDGE, EDGE_KEY, ORDERED, RMV_EDGE, Graph
from tidegraph.operators.marks import (
    alive_edges,
    edge_marks,
    graph_from_marks,
    node_removals,
    vertex_marks,
)


def expired(last_add_ts: Column, ttl_seconds: int, as_of: Column) -> Column:
    """True strictly after the time to live; an edge exactly that old stays."""
    return last_add_ts + F.make_dt_interval(secs=F.lit(ttl_seconds)) < as_of


def expired_edges(
    commands: DataFrame, ttl_seconds: int, as_of: Column, mode: str = ORDERED
) -> DataFrame:
    """Existing edges last added more than the time to live before ``as_of``."""
    seen = commands.filter(F.col("ts") <= as_of)
    alive = alive_edges(edge_marks(seen, mode), node_removals(seen, mode), mode)
    return alive.filter(expired(F.col("last_add_ts"), ttl_seconds, as_of)).select(
        *EDGE_KEY, "last_add_ts"
    )


def graph_with_expiry(
    commands: DataFrame, ttl_seconds: int, as_of: Column, mode: str = ORDERED
) -> Graph:
    """The graph at ``as_of`` less its expired edges. Vertices do not expire."""
    seen = commands.filter(F.col("ts") <= as_of)
    marks = edge_marks(seen, mode).filter(
        ~expired(F.col("last_add_ts"), ttl_seconds, as_of)
    )
    return graph_from_marks(marks, vertex_marks(seen, mode), mode, node_removals(seen, mode))


def expiry_commands(commands: DataFrame, ttl_seconds: int, until: Column) -> DataFrame:
    """The ``rmvEdge`` commands that ageing generates up to ``until``.

    One ``(ts, op, src, attr, dst)`` for every gap longer than the time to
    live between additions of an edge, stamped when the time to live ran out.

    Additions are first reduced to the first and last one per edge and
    interval of that length. No gap inside such an interval is long enough, so
    nothing is lost, and an edge that is added all the time leaves one row per
    interval for the ordered pass.
    """
    ttl = ttl_seconds * 1_000_000
    adds = commands.filter((F.col("op") == ADD_EDGE) & (F.col("ts") <= until))
    spans = (
        adds.select(*EDGE_KEY, epoch_micros(adds, "ts").alias("us"))
        .groupBy(*EDGE_KEY, F.floor(F.col("us") / ttl).alias("slot"))
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    )
    following = F.lead("first_us").over(Window.partitionBy(*EDGE_KEY).orderBy("slot"))
    due = F.col("last_us") + ttl
    out = (
        spans.withColumn("next_us", following)
        .filter(F.col("next_us").isNull() | (F.col("next_us") > due))
        .select(
            micros_to_timestamp(commands, "ts", due).alias("ts"),
            F.lit(RMV_EDGE).alias("op"),
            *EDGE_KEY,
        )
    )
    return out.filter(F.col("ts") < until)
