"""Reducing a batch of ordered commands to its net effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.model import (
    ADD_EDGE,
    ADD_NODE,
    EDGE_KEY,
    EDGE_OPS,
    NEVER,
    NODE_OPS,
    RMV_EDGE,
    RMV_NODE,
)
from tidegraph.operators.marks import with_endpoint_removals

COMMAND_KEY = ["op", "src", "attr", "dst"]


def dedup_commands(commands: DataFrame, by: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Identical commands of a batch collapse to one."""
    return commands.dropDuplicates([*by, *COMMAND_KEY])


def _at(op: str, column: str) -> Column:
    return F.max(F.when(F.col("op") == op, F.col(column)))


def _emit(condition: Column, op: str, src: str, ts: str, edge: bool) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit(op).alias("op"),
            F.col(src).alias("src"),
            (F.col("attr") if edge else F.lit(None).cast("string")).alias("attr"),
            (F.col("dst") if edge else F.lit(None).cast("long")).alias("dst"),
            F.col(ts).alias("ts"),
        ),
    )


def _emitted(rows: DataFrame, by: tuple[str, ...], *choices: Column) -> DataFrame:
    chosen = F.filter(F.array(*choices), lambda c: c.isNotNull())
    return rows.select(*by, F.explode(chosen).alias("c")).select(*by, "c.*")


def net_effect(
    commands: DataFrame,
    by: tuple[str, ...] = ("batch_id",),
) -> DataFrame:
    """The commands of each batch that still matter once the batch is over.

    Returns ``(by..., op, src, attr, dst, ts)``, one row per distinct command,
    meant to be applied removals first. Within a batch, by ``seq``:

    * an edge addition stays if neither the edge nor an endpoint is removed
      later; else it shrinks to additions of the endpoints not removed later;
    * a node addition stays unless the node is removed later;
    * an edge removal stays unless the edge is added again or an endpoint is
      removed later (which takes the edge along);
    * a node removal always stays: it may take along edges of older batches.

    ``ts`` is the time of the latest command behind the row.
    """
    if "ts" not in commands.columns:
        commands = commands.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    edges = (
        commands.filter(F.col("op").isin(*EDGE_OPS))
        .groupBy(*by, *EDGE_KEY)
        .agg(
            _at(ADD_EDGE, "seq").alias("added"),
            _at(RMV_EDGE, "seq").alias("removed"),
            _at(ADD_EDGE, "ts").alias("added_ts"),
            _at(RMV_EDGE, "ts").alias("removed_ts"),
        )
    )
    nodes = (
        commands.filter(F.col("op").isin(*NODE_OPS))
        .groupBy(*by, "src")
        .agg(
            _at(ADD_NODE, "seq").alias("added"),
            _at(RMV_NODE, "seq").alias("removed"),
            _at(ADD_NODE, "ts").alias("added_ts"),
            _at(RMV_NODE, "ts").alias("removed_ts"),
        )
    )
    removals = (
        commands.filter(F.col("op") == RMV_NODE)
        .groupBy(*by, F.col("src").alias("id"))
        .agg(F.max("seq").alias("removed_at"))
    )

    never = F.lit(NEVER)
    src_rmv = F.coalesce("src_rmv", never)
    dst_rmv = F.coalesce("dst_rmv", never)
    edges = (
        with_endpoint_removals(edges, removals, by)
        .withColumn("purged", F.greatest(F.coalesce("removed", never), src_rmv, dst_rmv))
        .withColumn("covered", F.greatest(F.coalesce("added", never), src_rmv, dst_rmv))
    )
    dead = F.col("added") <= F.col("purged")
    from_edges = _emitted(
        edges,
        by,
        _emit(F.col("added") > F.col("purged"), ADD_EDGE, "src", "added_ts", True),
        _emit(F.col("removed") > F.col("covered"), RMV_EDGE, "src", "removed_ts", True),
        _emit(dead & (F.col("added") > src_rmv), ADD_NODE, "src", "added_ts", False),
        _emit(dead & (F.col("added") > dst_rmv), ADD_NODE, "dst", "added_ts", False),
    )
    from_nodes = _emitted(
        nodes,
        by,
        _emit(
            F.col("added") > F.coalesce("removed", never), ADD_NODE, "src", "added_ts", False
        ),
        _emit(F.col("removed").isNotNull(), RMV_NODE, "src", "removed_ts", False),
    )
    return (
        from_edges.unionByName(from_nodes)
        .groupBy(*by, *COMMAND_KEY)
        .agg(F.max("ts").alias("ts"))
    )


def route_to_shards(commands: DataFrame, shards: int) -> DataFrame:
    """Add ``shard``: by source id, node removals copied to every shard.

    Every shard then sees all that can cancel its own edges, so reducing the
    shards apart and uniting them gives the same graph for any shard count.
    """
    home = F.array(F.pmod(F.col("src"), F.lit(shards)).cast("int"))
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    return commands.withColumn(
        "shard",
        F.explode(F.when(F.col("op") == RMV_NODE, everywhere).otherwise(home)),
    )


def combine_shards(reduced: DataFrame) -> DataFrame:
    """Unite reduced shards into one command set per batch."""
    return reduced.groupBy("batch_id", *COMMAND_KEY).agg(F.max("ts").alias("ts"))


def shard_counts(reduced: DataFrame) -> DataFrame:
    """``(batch_id, shard, n)``: the number of commands each shard announces."""
    return reduced.groupBy("batch_id", "shard").agg(F.count("*").alias("n"))


def batch_completeness(announced: DataFrame, received: DataFrame, shards: int) -> DataFrame:
    """Which batches have arrived whole.

    A batch is complete when all ``shards`` have announced a count and as many
    commands have been received as were announced.
    """
    promised = announced.groupBy("batch_id").agg(
        F.sum("n").alias("announced"), F.count_distinct("shard").alias("shards_seen")
    )
    arrived = received.groupBy("batch_id").agg(F.count("*").alias("received"))
    rows = promised.join(arrived, "batch_id", "full")
    filled = rows.select(
        "batch_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("announced", "shards_seen", "received")],
    )
    return filled.withColumn(
        "complete",
        (F.col("shards_seen") == shards) & (F.col("announced") == F.col("received")),
    )


def command_counts(commands: DataFrame, by: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Number of commands per batch and kind."""
    return commands.groupBy(*by, "op").agg(F.count("*").alias("n"))


def reduction_ratio(commands: DataFrame, reduced: DataFrame) -> DataFrame:
    """Commands per batch before and after reduction."""
    before = commands.groupBy("batch_id").agg(F.count("*").alias("n_raw"))
    after = reduced.groupBy("batch_id").agg(F.count("*").alias("n_reduced"))
    return before.join(after, "batch_id", "left").select(
        "batch_id",
        "n_raw",
        F.coalesce("n_reduced", F.lit(0)).alias("n_reduced"),
        (F.coalesce("n_reduced", F.lit(0)) / F.col("n_raw")).alias("ratio"),
    )
