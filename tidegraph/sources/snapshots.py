"""Saved graphs: a text form and a parquet form, each named by its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.model import Graph
from tidegraph.operators.graph import make_graph
from tidegraph.operators.temporal import nearest_snapshot, snapshot_times

# The two line forms of a saved graph.
VERTEX_LINE = r"^\((-?\d+),(-?\d+)\)$"
EDGE_LINE = r"^Edge\((-?\d+),(-?\d+),(.*)\)$"


def parse_vertex_lines(lines: DataFrame) -> DataFrame:
    """``(id, attr)`` of lines like ``(4904,1)``."""
    part = lambda i: F.regexp_extract("value", VERTEX_LINE, i).try_cast("bigint")
    return lines.select(part(1).alias("id"), part(2).alias("attr")).filter(
        F.col("id").isNotNull()
    )


def parse_edge_lines(lines: DataFrame) -> DataFrame:
    """``(src, dst, attr)`` of lines like ``Edge(17,4339,label)``; the label
    may itself hold commas and brackets."""
    part = lambda i: F.regexp_extract("value", EDGE_LINE, i)
    return lines.select(
        part(1).try_cast("bigint").alias("src"),
        part(2).try_cast("bigint").alias("dst"),
        part(3).alias("attr"),
    ).filter(F.col("src").isNotNull())


def vertex_lines(graph: Graph) -> DataFrame:
    return graph.vertices.select(F.format_string("(%d,%d)", "id", "attr").alias("value"))


def edge_lines(graph: Graph) -> DataFrame:
    return graph.edges.select(
        F.format_string("Edge(%d,%d,%s)", "src", "dst", "attr").alias("value")
    )


def write_snapshot_text(graph: Graph, root: str, name: str | int) -> None:
    """Save as text lines under ``root/name/{vertices,edges}``."""
    vertex_lines(graph).write.mode("overwrite").text(f"{root}/{name}/vertices")
    edge_lines(graph).write.mode("overwrite").text(f"{root}/{name}/edges")


def read_snapshot_text(spark: SparkSession, root: str, name: str | int) -> Graph:
    """A graph saved as text; endpoints without a vertex line are added."""
    lines = lambda what: spark.read.text(f"{root}/{name}/{what}/part-*")
    return make_graph(parse_vertex_lines(lines("vertices")), parse_edge_lines(lines("edges")))


def write_snapshot(graph: Graph, root: str, snapshot_ts: int) -> None:
    """Save as parquet; a snapshot saved again replaces only itself.

    Its two tables count together, once a mark is left under ``committed``; an
    unfinished snapshot is neither listed nor chosen.
    """
    spark = graph.edges.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    mark = hadoop.Path(f"{root}/committed/snapshot_ts={snapshot_ts}")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(mark, False)
    for what, rows in (("vertices", graph.vertices), ("edges", graph.edges)):
        rows.write.mode("overwrite").parquet(f"{root}/{what}/snapshot_ts={snapshot_ts}")
    fs.create(mark, True).close()


def read_snapshot(spark: SparkSession, root: str, snapshot_ts: int) -> Graph:
    """One saved graph; no other snapshot's files are listed or read."""
    part = lambda what: spark.read.parquet(f"{root}/{what}/snapshot_ts={snapshot_ts}")
    return Graph(part("vertices"), part("edges"))


def snapshot_names(spark: SparkSession, folder: str) -> DataFrame:
    """``(name)`` of the entries of a folder, from its listing alone."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return spark.createDataFrame([(n,) for n in names], "name string")


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """``(name, snapshot_ts)`` of the parquet snapshots that are complete."""
    names = snapshot_names(spark, f"{root}/committed")
    return snapshot_times(names.select(F.regexp_extract("name", r"=(\d+)$", 1).alias("name")))


def load_old(spark: SparkSession, root: str, at_millis: int, text: bool = False) -> Graph | None:
    """The saved graph nearest to a time; None if nothing is saved.

    Make it the state to go on from with ``graph.as_start_commands``.
    """
    names = snapshot_names(spark, root) if text else list_snapshots(spark, root)
    row = nearest_snapshot(names, at_millis).first()
    if row is None:
        return None
    if text:
        return read_snapshot_text(spark, root, row["name"])
    return read_snapshot(spark, root, row["snapshot_ts"])
