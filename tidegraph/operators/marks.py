"""Last-added / last-removed marks: the closed form of replaying commands.

Replay batch after batch is not needed to know a graph. For every edge and
every vertex only the latest addition and the latest removal matter::

    vertex alive  <=>  last_add outlives last_rmv
    edge alive    <=>  last_add outlives its own last_rmv and the last
                       removal of either endpoint

Both marks are ``max`` aggregates: they pre-aggregate before the shuffle, do
not care about the order, repetition or splitting of the input, and merge.
A hub vertex or an edge that is re-added endlessly shrinks to one row per task
before anything moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.keys import own_shuffle
from tidegraph.model import (
    ADD_EDGE,
    ADD_NODE,
    BATCH,
    DEFAULT_VERTEX_ATTR,
    EDGE_KEY,
    EDGE_OPS,
    NEVER,
    RMV_EDGE,
    RMV_NODE,
    Graph,
    order_key,
    outlives,
)


def _latest(condition: Column, value: Column) -> Column:
    return F.max(F.when(condition, value))


def edge_marks(commands: DataFrame, mode: str = BATCH) -> DataFrame:
    """``(src, attr, dst, last_add, last_rmv[, last_add_ts])`` per edge."""
    key = F.col(order_key(mode))
    is_add = F.col("op") == ADD_EDGE
    marks = [
        _latest(is_add, key).alias("last_add"),
        _latest(F.col("op") == RMV_EDGE, key).alias("last_rmv"),
    ]
    if "ts" in commands.columns:
        marks.append(_latest(is_add, F.col("ts")).alias("last_add_ts"))
    return commands.filter(F.col("op").isin(*EDGE_OPS)).groupBy(*EDGE_KEY).agg(*marks)


def vertex_events(commands: DataFrame, *keep: str) -> DataFrame:
    """One row ``(keep..., id, is_add)`` per vertex touched by a command.

    An edge addition adds both endpoints; an edge removal touches no vertex.
    """
    touched = (
        F.when(F.col("op") == ADD_EDGE, F.array("src", "dst"))
        .when(F.col("op").isin(ADD_NODE, RMV_NODE), F.array("src"))
    )
    return commands.filter(F.col("op") != RMV_EDGE).select(
        *keep,
        F.explode(touched).alias("id"),
        (F.col("op") != RMV_NODE).alias("is_add"),
    )


def vertex_marks(commands: DataFrame, mode: str = BATCH) -> DataFrame:
    """``(id, last_add, last_rmv)`` per vertex."""
    key = order_key(mode)
    return (
        vertex_events(commands, key)
        .groupBy("id")
        .agg(
            _latest(F.col("is_add"), F.col(key)).alias("last_add"),
            _latest(~F.col("is_add"), F.col(key)).alias("last_rmv"),
        )
    )


def node_removals(commands: DataFrame, mode: str = BATCH) -> DataFrame:
    """``(id, removed_at)``: vertices with a removal only.

    The filter on ``op`` reaches the scan, so this is the narrow side of the
    joins that check an edge's endpoints.
    """
    return (
        commands.filter(F.col("op") == RMV_NODE)
        .groupBy(F.col("src").alias("id"))
        .agg(F.max(order_key(mode)).alias("removed_at"))
    )


def prune_edge_additions(commands: DataFrame, removals: DataFrame, mode: str = BATCH) -> DataFrame:
    """The edge commands without the additions an endpoint's removal undid."""
    edges = commands.filter(F.col("op").isin(*EDGE_OPS))
    key = F.col(order_key(mode))
    checked = with_endpoint_removals(edges, removals).filter(
        (F.col("op") != ADD_EDGE)
        | (outlives(key, F.col("src_rmv"), mode) & outlives(key, F.col("dst_rmv"), mode))
    )
    return checked.select(*commands.columns)


def removals_from_marks(vertex_marks_df: DataFrame) -> DataFrame:
    """:func:`node_removals` out of stored vertex marks."""
    return vertex_marks_df.filter(F.col("last_rmv").isNotNull()).select(
        "id", F.col("last_rmv").alias("removed_at")
    )


def with_endpoint_removals(
    edges: DataFrame, removals: DataFrame, by: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``src_rmv`` and ``dst_rmv``, the last removal of each endpoint.

    Both joins are many-to-one, so they add no rows. Spark broadcasts the
    removals only where their measured size allows; otherwise adaptive
    execution splits a hub's edges over several tasks.
    """
    for end in ("src", "dst"):
        side = removals.select(
            *by, own_shuffle("id").alias(end), F.col("removed_at").alias(end + "_rmv")
        )
        edges = edges.join(side, [*by, end], "left")
    return edges


def alive_edges(edge_marks_df: DataFrame, removals: DataFrame, mode: str = BATCH) -> DataFrame:
    """The edge marks of the edges that exist."""
    candidates = edge_marks_df.filter(
        F.col("last_add").isNotNull()
        & outlives(F.col("last_add"), F.col("last_rmv"), mode)
    )
    checked = with_endpoint_removals(candidates, removals).filter(
        outlives(F.col("last_add"), F.col("src_rmv"), mode)
        & outlives(F.col("last_add"), F.col("dst_rmv"), mode)
    )
    return checked.select(*edge_marks_df.columns)


def alive_vertices(vertex_marks_df: DataFrame, mode: str = BATCH) -> DataFrame:
    """The vertex marks of the vertices that exist."""
    return vertex_marks_df.filter(
        F.col("last_add").isNotNull()
        & outlives(F.col("last_add"), F.col("last_rmv"), mode)
    )


def graph_from_marks(
    edge_marks_df: DataFrame,
    vertex_marks_df: DataFrame,
    mode: str = BATCH,
    removals: DataFrame | None = None,
) -> Graph:
    """The graph described by stored marks."""
    if removals is None:
        removals = removals_from_marks(vertex_marks_df)
    vertices = alive_vertices(vertex_marks_df, mode).select(
        "id", F.lit(DEFAULT_VERTEX_ATTR).cast("long").alias("attr")
    )
    edges = alive_edges(edge_marks_df, removals, mode).select("src", "dst", "attr")
    return Graph(vertices, edges)


def build_graph(
    commands: DataFrame, mode: str = BATCH, prune_early: bool = False
) -> Graph:
    """Apply all commands to the empty graph.

    ``ordered``: as if replayed one by one by ``seq``. ``batch``: as if folded
    batch by batch, removals before additions within each ``batch_id``.

    Edges are reduced to one row each before they meet the removals. With
    ``prune_early`` every command meets them first, and additions they undid
    are not reduced at all; Spark broadcasts the removals if they turn out
    small, so this pays where removals are few and undo much.
    """
    removals = node_removals(commands, mode)
    vertices = alive_vertices(vertex_marks(commands, mode), mode).select(
        "id", F.lit(DEFAULT_VERTEX_ATTR).cast("long").alias("attr")
    )
    if not prune_early:
        edges = alive_edges(edge_marks(commands, mode), removals, mode)
    else:
        pruned = edge_marks(prune_edge_additions(commands, removals, mode), mode)
        edges = pruned.filter(
            F.col("last_add").isNotNull()
            & outlives(F.col("last_add"), F.col("last_rmv"), mode)
        )
    return Graph(vertices, edges.select("src", "dst", "attr"))


def merge_marks(*parts: DataFrame) -> DataFrame:
    """Merge edge marks, or vertex marks, of separate parts of the input."""
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    keys = [c for c in merged.columns if not c.startswith("last_")]
    return merged.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in merged.columns if c.startswith("last_")]
    )


def explicit_never(marks: DataFrame) -> DataFrame:
    """Marks with ``-1`` in place of null, for export."""
    return marks.select(
        *[
            F.coalesce(c, F.lit(NEVER)).alias(c) if c in ("last_add", "last_rmv") else c
            for c in marks.columns
        ]
    )
