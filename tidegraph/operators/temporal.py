"""Graphs at a moment: nearest saved graph, graph as of a time or batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.model import BATCH, ORDERED, Graph
from tidegraph.operators.marks import build_graph


def snapshot_times(names: DataFrame, name_col: str = "name") -> DataFrame:
    """``(name, snapshot_ts)`` of the names that are numbers."""
    ts = F.col(name_col).try_cast("bigint")
    return names.select(F.col(name_col).alias("name"), ts.alias("snapshot_ts")).filter(
        F.col("snapshot_ts").isNotNull()
    )


def nearest_snapshot(names: DataFrame, at: Column | int, name_col: str = "name") -> DataFrame:
    """The saved graph closest to an epoch-millisecond time; none if no name
    is a number. Of two equally close ones the earlier is taken."""
    at = F.lit(at) if isinstance(at, int) else at
    listed = snapshot_times(names, name_col).withColumn("distance", F.abs(F.col("snapshot_ts") - at))
    return listed.orderBy("distance", "snapshot_ts", "name").limit(1)


def nearest_snapshots(
    probes: DataFrame,
    probe_col: str,
    snapshots: DataFrame,
    snapshot_col: str = "snapshot_ts",
    bucket_millis: int = 1 << 20,
) -> DataFrame:
    """Add ``nearest_ts``, the snapshot time closest to each probe time.

    Ties go to the earlier snapshot; null where there is no snapshot at all.

    Probe and snapshot times are first reduced to distinct milliseconds, so a
    time bucket never holds more than ``bucket_millis`` rows, however many
    probes share it. Inside a bucket two ordered passes find the neighbours;
    a table with one row per bucket (thirty thousand a year by default) supplies
    those that lie outside.
    """
    at, flag = F.col("t"), F.col("is_snapshot")
    points = (
        probes.select(F.col(probe_col).alias("t"), F.lit(False).alias("is_snapshot"))
        .unionByName(
            snapshots.select(F.col(snapshot_col).alias("t"), F.lit(True).alias("is_snapshot"))
        )
        .filter(at.isNotNull())
        .groupBy("t")
        .agg(F.bool_or("is_snapshot").alias("is_snapshot"))
        .withColumn("bucket", F.floor(at / bucket_millis))
    )
    snap = F.when(flag, at)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        points.groupBy("bucket")
        .agg(F.min(snap).alias("first"), F.max(snap).alias("last"))
        .select(
            "bucket",
            F.max("last").over(before).alias("before_bucket"),
            F.min("first").over(after).alias("after_bucket"),
        )
    )
    back = Window.partitionBy("bucket").orderBy("t")
    ahead = Window.partitionBy("bucket").orderBy(F.col("t").desc())
    upto = (Window.unboundedPreceding, Window.currentRow)
    lower = F.coalesce("lower", "before_bucket")
    upper = F.coalesce("upper", "after_bucket")
    nearest = (
        points.withColumn("lower", F.last(snap, ignorenulls=True).over(back.rowsBetween(*upto)))
        .withColumn("upper", F.last(snap, ignorenulls=True).over(ahead.rowsBetween(*upto)))
        .join(carried, "bucket")
        .select(
            at.alias(probe_col),
            F.when(upper.isNull() | (at - lower <= upper - at), lower)
            .otherwise(upper)
            .alias("nearest_ts"),
        )
    )
    return probes.join(nearest, probe_col, "left")


def graph_as_of_batch(commands: DataFrame, batch_id: int, mode: str = BATCH) -> Graph:
    """The graph after the given batch. Stored batches beyond it are not read."""
    return build_graph(commands.filter(F.col("batch_id") <= batch_id), mode)


def graph_as_of_seq(commands: DataFrame, seq: int) -> Graph:
    """The graph after the given command."""
    return build_graph(commands.filter(F.col("seq") <= seq), ORDERED)


def graph_as_of_time(commands: DataFrame, at: Column, mode: str = ORDERED) -> Graph:
    """The graph at a moment of the commands' own clock."""
    return build_graph(commands.filter(F.col("ts") <= at), mode)
