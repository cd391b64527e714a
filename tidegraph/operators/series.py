"""Histories: how many edges and vertices existed after each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.keys import own_shuffle
from tidegraph.model import ADD_EDGE, BATCH, EDGE_KEY, EDGE_OPS, RMV_EDGE, order_key, outlives
from tidegraph.operators.marks import (
    node_removals,
    vertex_events,
    with_endpoint_removals,
)


def running_totals(
    df: DataFrame, key: str, values: list[str], width: int = 4096
) -> DataFrame:
    """Running sums of ``values`` by ascending ``key``, one row per key.

    Keys are summed in buckets of ``width`` consecutive values first; only the
    bucket totals pass through one ordered window, and the rows of a bucket
    (at most ``width``) through another. ``df`` feeds both, so it should end
    in an aggregation: its shuffle is then run once and read twice.
    """
    # Never null: a null test on one side only would make the two plans differ.
    bucket = F.coalesce(F.floor(F.col(key) / width), F.lit(-1).cast("long"))
    df = df.select(key, *values).withColumn("_bucket", bucket)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy("_bucket")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(
            "_bucket",
            *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias("_before_" + v) for v in values],
        )
    )
    within = (
        Window.partitionBy("_bucket")
        .orderBy(key)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.join(offsets, "_bucket").select(
        key, *[(F.sum(v).over(within) + F.col("_before_" + v)).alias(v) for v in values]
    )


def _next_removal(keys: list[str]) -> Column:
    """The nearest later batch, for the same key, that holds a removal.

    Looks back along descending batches, which Spark evaluates in one pass.
    """
    later = (
        Window.partitionBy(*keys)
        .orderBy(F.col("batch_id").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.last(F.when(F.col("n_rmv") > 0, F.col("batch_id")), ignorenulls=True).over(later)


def _edge_lives(commands: DataFrame, vertex_steps: DataFrame) -> DataFrame:
    """``(src, attr, dst, start, end, n)``: additions and the batch that ends them."""
    steps = (
        commands.filter(F.col("op").isin(*EDGE_OPS))
        .groupBy(*EDGE_KEY, "batch_id")
        .agg(
            F.count_if(F.col("op") == ADD_EDGE).alias("n"),
            F.count_if(F.col("op") == RMV_EDGE).alias("n_rmv"),
        )
        .withColumn("own_end", _next_removal(EDGE_KEY))
        .filter(F.col("n") > 0)
    )
    ends = vertex_steps.filter((F.col("n") > 0) & F.col("end").isNotNull()).select(
        "batch_id", "id", F.col("end").alias("removed_at")
    )
    return with_endpoint_removals(steps, ends, ("batch_id",)).select(
        *EDGE_KEY,
        F.col("batch_id").alias("start"),
        F.least("own_end", "src_rmv", "dst_rmv").alias("end"),
        "n",
    )


def _vertex_steps(commands: DataFrame) -> DataFrame:
    # The null tests are those the joins imply; stated here, they make the
    # plans of all uses alike, so that the shuffles are shared.
    return (
        vertex_events(commands, "batch_id")
        .filter(
            F.col("id").isNotNull()
            & own_shuffle("id").isNotNull()
            & F.col("batch_id").isNotNull()
        )
        .groupBy("id", "batch_id")
        .agg(
            F.count_if("is_add").alias("n"),
            F.count_if(~F.col("is_add")).alias("n_rmv"),
        )
        .withColumn("end", _next_removal(["id"]))
    )


def _lives(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    vertex_steps = _vertex_steps(commands)
    vertices = vertex_steps.filter(F.col("n") > 0).select(
        "id", F.col("batch_id").alias("start"), "end", "n"
    )
    return _edge_lives(commands, vertex_steps), vertices


def edge_intervals(commands: DataFrame) -> DataFrame:
    """``(src, attr, dst, start, end)``: the batches between which an edge
    existed; ``end`` is the batch of its removal, null if it still exists."""
    edges, _ = _lives(commands)
    return edges.groupBy(*EDGE_KEY, "end").agg(F.min("start").alias("start")).select(
        *EDGE_KEY, "start", "end"
    )


def vertex_intervals(commands: DataFrame) -> DataFrame:
    """``(id, start, end)``: the batches between which a vertex existed."""
    _, vertices = _lives(commands)
    return vertices.groupBy("id", "end").agg(F.min("start").alias("start")).select(
        "id", "start", "end"
    )


def count_changes(commands: DataFrame, copies: bool = False) -> DataFrame:
    """``(batch_id, n_edges, n_vertices)``: by how much each batch changes the counts,
    removals first.

    Every life of an edge or vertex counts +1 at its start and -1 at its end.
    Groups are per edge or vertex and batch, so no group is longer than there
    are batches, however hot a key is.
    """
    edges, vertices = _lives(commands)
    if not copies:
        one = F.lit(1).cast("long").alias("n")
        edges = edges.groupBy(*EDGE_KEY, "end").agg(F.min("start").alias("start"))
        vertices = vertices.groupBy("id", "end").agg(F.min("start").alias("start"))
        edges = edges.select("start", "end", one)
        vertices = vertices.select("start", "end", one)

    def changes(lives: DataFrame, e: Column, v: Column) -> DataFrame:
        steps = F.array(
            F.struct(F.col("start").alias("batch_id"), F.col("n").alias("d")),
            F.struct(F.col("end").alias("batch_id"), (-F.col("n")).alias("d")),
        )
        return (
            lives.select(F.explode(steps).alias("s"))
            .filter(F.col("s.batch_id").isNotNull())
            .select("s.batch_id", (F.col("s.d") * e).alias("n_edges"), (F.col("s.d") * v).alias("n_vertices"))
        )

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    batches = commands.select("batch_id", none.alias("n_edges"), none.alias("n_vertices"))
    return (
        changes(edges, one, none)
        .unionByName(changes(vertices, none, one))
        .unionByName(batches)
        .groupBy("batch_id")
        .agg(F.sum("n_edges").alias("n_edges"), F.sum("n_vertices").alias("n_vertices"))
    )


def count_series(commands: DataFrame, copies: bool = False) -> DataFrame:
    """``(batch_id, n_edges, n_vertices)`` after each batch, removals first: the running
    total of :func:`count_changes`, which are few.

    ``copies=True`` counts additions instead: an edge added in two batches
    counts twice until it is removed, with all its copies.
    """
    return running_totals(count_changes(commands, copies), "batch_id", ["n_edges", "n_vertices"])


def edge_copies(commands: DataFrame, mode: str = BATCH) -> DataFrame:
    """``(src, attr, dst, copies)``: additions since the edge last vanished."""
    key = order_key(mode)
    adds = (
        commands.filter(F.col("op") == ADD_EDGE)
        .groupBy(*EDGE_KEY, key)
        .agg(F.count("*").alias("n"))
    )
    own = (
        commands.filter(F.col("op") == RMV_EDGE)
        .groupBy(*EDGE_KEY)
        .agg(F.max(key).alias("own_rmv"))
        .withColumn("src", own_shuffle("src"))
    )
    checked = with_endpoint_removals(adds.join(own, EDGE_KEY, "left"), node_removals(commands, mode))
    alive = outlives(F.col(key), F.col("own_rmv"), mode)
    for end in ("src_rmv", "dst_rmv"):
        alive = alive & outlives(F.col(key), F.col(end), mode)
    return checked.filter(alive).groupBy(*EDGE_KEY).agg(F.sum("n").alias("copies"))


def vertex_copies(commands: DataFrame, mode: str = BATCH) -> DataFrame:
    """``(id, copies)``: additions since the vertex last vanished.

    The additions of a hub are summed in parts first. Their key is hidden, so that
    the join before need not keep the rows of a vertex together and can be split.
    """
    key = order_key(mode)
    adds = (
        vertex_events(commands, key)
        .filter("is_add")
        .groupBy("id", key)
        .agg(F.count("*").alias("n"))
    )
    alive = (
        adds.join(node_removals(commands, mode).withColumn("id", own_shuffle("id")), "id", "left")
        .filter(outlives(F.col(key), F.col("removed_at"), mode))
    )
    parts = alive.groupBy(own_shuffle("id").alias("id"), F.pmod(F.xxhash64(key), F.lit(64)).alias("part"))
    return parts.agg(F.sum("n").alias("n")).groupBy("id").agg(F.sum("n").alias("copies"))
