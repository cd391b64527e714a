"""Data model: command rows, the graph value, and the two orders of replay.

A *command* is one row ``(seq, batch_id, ts, op, src, attr, dst)``. Node
commands leave ``attr`` and ``dst`` null. An edge is identified by the triple
``(src, attr, dst)``; a vertex by its id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The command vocabulary.
ADD_NODE = "addNode"
RMV_NODE = "rmvNode"
ADD_EDGE = "addEdge"
RMV_EDGE = "rmvEdge"
NODE_OPS = (ADD_NODE, RMV_NODE)
EDGE_OPS = (ADD_EDGE, RMV_EDGE)
ALL_OPS = (ADD_EDGE, ADD_NODE, RMV_EDGE, RMV_NODE)

# ORDERED: commands take effect one by one by ``seq``.
# BATCH: per ``batch_id`` all removals take effect, then all additions.
ORDERED = "ordered"
BATCH = "batch"

EDGE_KEY = ["src", "attr", "dst"]
DEFAULT_VERTEX_ATTR = 1

# Key given to a start state; every real batch_id / seq must be larger than
# NEVER, and larger than START_KEY once a start state is loaded.
START_KEY = 0
NEVER = -1

COMMAND_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("op", T.StringType()),
        T.StructField("src", T.LongType()),
        T.StructField("attr", T.StringType()),
        T.StructField("dst", T.LongType()),
    ]
)
VERTEX_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("attr", T.LongType())]
)
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("attr", T.StringType()),
    ]
)


def order_key(mode: str) -> str:
    """The command column that orders changes in the given mode."""
    if mode == ORDERED:
        return "seq"
    if mode == BATCH:
        return "batch_id"
    raise ValueError(f"unknown mode {mode!r}")


def outlives(added: Column, removed: Column, mode: str) -> Column:
    """True where an addition survives a removal (null removal = never).

    In batch mode removals come first, so an addition in the same batch wins.
    """
    order_key(mode)
    removed = F.coalesce(removed, F.lit(NEVER))
    return added > removed if mode == ORDERED else added >= removed


@dataclass(frozen=True)
class Graph:
    """A directed labelled graph held as two DataFrames."""

    vertices: DataFrame  # id, attr
    edges: DataFrame  # src, dst, attr

    def register(self, prefix: str = "") -> None:
        """Expose the graph to ``spark.sql`` as temporary views."""
        from tidegraph.operators.graph import triplets

        self.vertices.createOrReplaceTempView(prefix + "vertices")
        self.edges.createOrReplaceTempView(prefix + "edges")
        triplets(self).createOrReplaceTempView(prefix + "triplets")


def empty_graph(spark: SparkSession) -> Graph:
    """The graph with no vertices and no edges."""
    return Graph(
        spark.createDataFrame([], VERTEX_SCHEMA),
        spark.createDataFrame([], EDGE_SCHEMA),
    )
