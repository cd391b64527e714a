"""Set operations on tables and comparison of graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.keys import unique_keys
from tidegraph.model import Graph
from tidegraph.operators.graph import triplets

TRIPLET = ["src", "src_attr", "dst", "dst_attr", "attr"]
VERTEX = ["id", "attr"]
EDGE = ["src", "dst", "attr"]


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` that do not occur in ``right``; copies are kept.

    Nulls are equal to each other. A row that makes up most of ``left`` is split
    over tasks by adaptive execution.
    """
    columns = left.columns
    listed = unique_keys(right, *columns).toDF(*[f"_listed_{c}" for c in columns])
    same = [left[c].eqNullSafe(listed[f"_listed_{c}"]) for c in columns]
    return left.join(listed, reduce(lambda a, b: a & b, same), "left_anti").select(*columns)


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both, copies kept."""
    return left.unionByName(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that occur in both, each side reduced before the shuffle."""
    both = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    return side_counts(left, right, left.columns).filter(both).select(*left.columns)


def matching_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``; copies are kept."""
    listed = unique_keys(right, key)
    return left.join(listed, key, "left_semi").select(*left.columns)


def sort_by_batch(df: DataFrame, name: str = "batch_id") -> DataFrame:
    """Order by the number in ``name``, not by its text."""
    return df.orderBy(F.col(name).cast("long"))


def side_counts(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Copies of each row on either side.

    Every comparison below is a sum over this one pre-aggregated shuffle.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return (
        left.select(*columns, one.alias("n_left"), none.alias("n_right"))
        .unionByName(right.select(*columns, none.alias("n_left"), one.alias("n_right")))
        .groupBy(*columns)
        .agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    )


def _tally(left: DataFrame, right: DataFrame, columns: list[str], what: str) -> DataFrame:
    in_left, in_right = F.col("n_left") > 0, F.col("n_right") > 0
    return side_counts(left, right, columns).select(
        F.lit(what).alias("what"),
        F.when(~in_right, F.col("n_left")).otherwise(0).alias("only_left"),
        F.when(~in_left, F.col("n_right")).otherwise(0).alias("only_right"),
        in_left.cast("long").alias("kinds_left"),
        (in_left & in_right).cast("long").alias("kinds_both"),
        "n_left",
        "n_right",
    )


def _report(left: Graph, right: Graph, with_attrs: bool) -> DataFrame:
    """One row with the tallies of both tables as ``vertex_*`` and ``edge_*``."""
    edge_sides = (
        (triplets(left, dangling=True), triplets(right, dangling=True), TRIPLET)
        if with_attrs
        else (left.edges, right.edges, EDGE)
    )
    rows = _tally(left.vertices, right.vertices, VERTEX, "vertex").unionByName(
        _tally(*edge_sides, "edge")
    )
    measures = [c for c in rows.columns if c != "what"]
    return rows.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("what") == w, F.col(m))), F.lit(0)).alias(f"{w}_{m}")
            for w in ("vertex", "edge")
            for m in measures
        ]
    )


def graphs_equal(left: Graph, right: Graph) -> DataFrame:
    """Exact comparison: one row with ``equal`` and the four difference counts.

    Equal when no vertex and no triplet occurs on one side only; an edge whose
    endpoint is in no vertex table is a triplet without that attribute.
    """
    names = ["vertex_only_left", "vertex_only_right", "edge_only_left", "edge_only_right"]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return _report(left, right, with_attrs=True).select((total == 0).alias("equal"), *names)


def graphs_equal_by_counts(left: Graph, right: Graph) -> DataFrame:
    """Comparison by counts: distinct left edges, common edges and right edges
    are equally many, and so for vertices. Copies on the right make a difference."""
    return _report(left, right, with_attrs=False).select(
        (
            (F.col("vertex_n_left") == F.col("vertex_kinds_both"))
            & (F.col("vertex_n_left") == F.col("vertex_n_right"))
            & (F.col("edge_kinds_left") == F.col("edge_kinds_both"))
            & (F.col("edge_kinds_left") == F.col("edge_n_right"))
        ).alias("equal"),
        F.col("vertex_n_left").alias("vertices_left"),
        F.col("vertex_kinds_both").alias("vertices_common"),
        F.col("vertex_n_right").alias("vertices_right"),
        F.col("edge_kinds_left").alias("edges_left"),
        F.col("edge_kinds_both").alias("edges_common"),
        F.col("edge_n_right").alias("edges_right"),
    )


def graph_contained(left: Graph, right: Graph) -> DataFrame:
    """Whether every vertex and edge of ``left`` is in ``right`` and none of
    them occurs twice in ``left``."""
    return _report(left, right, with_attrs=False).select(
        (
            (F.col("vertex_n_left") == F.col("vertex_kinds_both"))
            & (F.col("edge_n_left") == F.col("edge_kinds_both"))
        ).alias("contained"),
        F.col("vertex_n_left").alias("vertices_left"),
        F.col("vertex_kinds_both").alias("vertices_common"),
        F.col("edge_n_left").alias("edges_left"),
        F.col("edge_kinds_both").alias("edges_common"),
    )


def _changes(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    change = F.when(F.col("n_left") == 0, "added").when(F.col("n_right") == 0, "removed")
    return (
        side_counts(old, new, columns)
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select("change", *columns)
    )


def vertex_diff(old: Graph, new: Graph) -> DataFrame:
    """``(change, id, attr)``: vertices added and removed from old to new."""
    return _changes(old.vertices, new.vertices, VERTEX)


def edge_diff(old: Graph, new: Graph) -> DataFrame:
    """``(change, src, dst, attr)``: edges added and removed from old to new."""
    return _changes(old.edges, new.edges, EDGE)
