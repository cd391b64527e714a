"""Graph operators on vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.keys import own_shuffle, unique_keys
from tidegraph.model import (
    ADD_EDGE,
    ADD_NODE,
    DEFAULT_VERTEX_ATTR,
    EDGE_KEY,
    RMV_EDGE,
    RMV_NODE,
    START_KEY,
    Graph,
)


def edges_of(commands: DataFrame, op: str) -> DataFrame:
    """The edges named by the edge commands of one kind, copies kept."""
    return commands.filter(F.col("op") == op).select("src", "dst", "attr")


def nodes_of(commands: DataFrame, op: str) -> DataFrame:
    """The ids named by the node commands of one kind, copies kept."""
    return commands.filter(F.col("op") == op).select(F.col("src").alias("id"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every edge, copies kept."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def remove_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """All copies of the edges whose (src, attr, dst) is listed go."""
    listed = unique_keys(removed, *EDGE_KEY)
    return edges.join(listed, EDGE_KEY, "left_anti").select(*edges.columns)


def remove_vertices(vertices: DataFrame, removed: DataFrame) -> DataFrame:
    """All copies of the listed vertices go."""
    listed = unique_keys(removed, "id")
    return vertices.join(listed, "id", "left_anti").select(*vertices.columns)


def remove_incident_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The edges that start or end at a listed vertex go."""
    columns, listed = edges.columns, unique_keys(removed, "id")
    for end in ("src", "dst"):
        edges = edges.join(listed.withColumnRenamed("id", end), end, "left_anti")
    return edges.select(*columns)


def add_rows(table: DataFrame, added: DataFrame) -> DataFrame:
    """Add vertices or edges; copies are kept."""
    return table.unionByName(added.select(*table.columns))


def apply_batch(graph: Graph, commands: DataFrame, distinct: bool = True) -> Graph:
    """Apply one batch to a graph: removals first, then additions.

    For a whole history use ``marks.build_graph`` instead of a loop over this.
    ``distinct=False`` keeps copies, as when batches are united as bags.
    """
    attr = F.lit(DEFAULT_VERTEX_ATTR).cast("long").alias("attr")
    gone = nodes_of(commands, RMV_NODE)
    new_edges = edges_of(commands, ADD_EDGE)
    new_nodes = nodes_of(commands, ADD_NODE).unionByName(endpoints(new_edges))
    edges = add_rows(
        remove_incident_edges(
            remove_edges(graph.edges, edges_of(commands, RMV_EDGE)), gone
        ),
        new_edges,
    )
    vertices = add_rows(
        remove_vertices(graph.vertices, gone), new_nodes.select("id", attr)
    )
    if distinct:
        edges, vertices = edges.distinct(), vertices.distinct()
    return Graph(vertices, edges)


def make_graph(
    vertices: DataFrame, edges: DataFrame, default_attr: int = DEFAULT_VERTEX_ATTR
) -> Graph:
    """A graph whose vertex table has each id once and misses no endpoint.

    Listed vertices keep their attribute (the smallest, if listed with
    several); endpoints that are not listed get ``default_attr``. One
    aggregation decides both, without a join.
    """
    listed = vertices.select("id", F.col("attr").cast("long").alias("attr"))
    implied = endpoints(edges).select("id", F.lit(None).cast("long").alias("attr"))
    return Graph(
        listed.unionByName(implied)
        .groupBy("id")
        .agg(F.coalesce(F.min("attr"), F.lit(default_attr).cast("long")).alias("attr")),
        edges.select("src", "dst", "attr"),
    )


def graph_from_edges(edges: DataFrame, attr: int = DEFAULT_VERTEX_ATTR) -> Graph:
    """The graph of the edges and nothing but their endpoints."""
    vertices = endpoints(edges).distinct()
    return Graph(
        vertices.select("id", F.lit(attr).cast("long").alias("attr")),
        edges.select("src", "dst", "attr"),
    )


def triplets(graph: Graph, dangling: bool = False) -> DataFrame:
    """Each edge with the attributes of both endpoints; with ``dangling`` also
    the edges that lack an endpoint, its attribute being null."""
    joined = graph.edges
    for end in ("src", "dst"):
        side = graph.vertices.select(
            own_shuffle("id").alias(end), F.col("attr").alias(end + "_attr")
        )
        joined = joined.join(side, end, "left" if dangling else "inner")
    return joined.select("src", "src_attr", "dst", "dst_attr", "attr")


def subgraph(
    graph: Graph, edge_where: Column | None = None, vertex_where: Column | None = None
) -> Graph:
    """Vertices passing ``vertex_where`` (over id, attr) and the edges passing
    ``edge_where`` (over the triplet columns) between such vertices.

    Vertices are filtered before they meet the edges, so edges that lose an
    end go in the same two joins that fetch the vertex attributes.
    """
    vertices = graph.vertices
    if vertex_where is not None:
        vertices = vertices.filter(vertex_where)
    edges = triplets(Graph(vertices, graph.edges))
    if edge_where is not None:
        edges = edges.filter(edge_where)
    return Graph(vertices, edges.select("src", "dst", "attr"))


def merge_parallel_edges(edges: DataFrame, separator: str = " ") -> DataFrame:
    """One edge per (src, dst); differing labels are joined in sorted order.

    Copies are dropped before the labels meet, so the one row that holds a
    pair's labels is as long as its result has to be and no longer.
    """
    return (
        edges.select("src", "dst", "attr")
        .distinct()
        .groupBy("src", "dst")
        .agg(F.array_join(F.array_sort(F.collect_set("attr")), separator).alias("attr"))
    )


def counts(graph: Graph) -> DataFrame:
    """One row: number of edges and vertices."""
    rows = graph.edges.select(F.lit(1).alias("e"), F.lit(0).alias("v")).unionByName(
        graph.vertices.select(F.lit(0).alias("e"), F.lit(1).alias("v"))
    )
    return rows.agg(
        F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("n_edges"),
        F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("n_vertices"),
    )


def as_start_commands(graph: Graph) -> DataFrame:
    """A saved graph as additions that precede every command of the history.

    Unite them with the commands to start from that graph instead of the
    empty one; the history's ``seq`` and ``batch_id`` must be 1 or more.
    """
    key = F.lit(START_KEY).cast("long")
    when = F.lit(None).cast("timestamp_ntz").alias("ts")
    nodes = graph.vertices.select(
        key.alias("seq"),
        key.alias("batch_id"),
        when,
        F.lit(ADD_NODE).alias("op"),
        F.col("id").alias("src"),
        F.lit(None).cast("string").alias("attr"),
        F.lit(None).cast("long").alias("dst"),
    )
    edges = graph.edges.select(
        key.alias("seq"),
        key.alias("batch_id"),
        when,
        F.lit(ADD_EDGE).alias("op"),
        "src",
        "attr",
        "dst",
    )
    return nodes.unionByName(edges)


def canonical_cut(edges: DataFrame, parts: int) -> DataFrame:
    """Add ``part_id`` so that all edges between two vertices, in whichever
    direction, share a part."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    part = F.pmod(F.xxhash64(low, high), F.lit(parts)).cast("int")
    return edges.withColumn("part_id", part)


def grid_cut(edges: DataFrame, parts: int) -> DataFrame:
    """Add ``part_id`` by source row and target column of a square grid, so
    that a vertex meets at most ``2 * ceil(sqrt(parts))`` parts."""
    side = 1
    while side * side < parts:
        side += 1
    row = F.pmod(F.xxhash64("src"), F.lit(side))
    column = F.pmod(F.xxhash64("dst"), F.lit(side))
    return edges.withColumn("part_id", ((row * side + column) % parts).cast("int"))


def lay_out(edges: DataFrame, parts: int) -> DataFrame:
    """Move edges so that rows of one ``part_id`` are in one partition."""
    return edges.repartitionById(parts, "part_id")
