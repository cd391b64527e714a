"""Saved graphs that can be compared without being read.

Rows go to buckets by a hash of all their columns. Beside them stands a digest of
each bucket: the number of rows and two sums of 64-bit hashes, in any order and
without overflow. Graphs are equal where all digests are, and differ in the buckets
whose digests do: a comparison reads digests, a difference the differing buckets.

    root/rows/{vertices,edges}/snapshot_ts=T/bucket=B/
    root/digests/snapshot_ts=T/        written last; a snapshot without is not there
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.model import EDGE_SCHEMA, VERTEX_SCHEMA, Graph
from tidegraph.operators.compare import EDGE, VERTEX, side_counts

BUCKETS = 64
_DIGEST = "what string, bucket int, n long, sum_1 decimal(38,0), sum_2 decimal(38,0)"
_TABLES = {"vertices": (VERTEX, VERTEX_SCHEMA), "edges": (EDGE, EDGE_SCHEMA)}


def _sum(seed: int, columns: list[str]) -> Column:
    return F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).cast("decimal(38,0)")


def _with_bucket(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])


def write_digested(graph: Graph, root: str, snapshot_ts: int, buckets: int = BUCKETS) -> None:
    """Save a graph with its digests; a snapshot saved again replaces only itself.

    Snapshots that are to be compared need the same number of buckets. A bucket
    is written by several tasks where it is large.
    """
    spark = graph.edges.sparkSession
    digests = None
    for what, rows in (("vertices", graph.vertices), ("edges", graph.edges)):
        columns, schema = _TABLES[what]
        path = f"{root}/rows/{what}/snapshot_ts={snapshot_ts}"
        bucket = F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
        (
            rows.select(*schema.names).withColumn("bucket", bucket).hint("rebalance", "bucket")
            .write.mode("overwrite").partitionBy("bucket").parquet(path)
        )
        some = spark.read.schema(_with_bucket(schema)).parquet(path).groupBy("bucket").agg(
            F.count("*").alias("n"), _sum(1, columns).alias("sum_1"), _sum(2, columns).alias("sum_2")
        ).select(F.lit(what).alias("what"), "bucket", "n", "sum_1", "sum_2")
        digests = some if digests is None else digests.unionByName(some)
    digests.coalesce(1).write.mode("overwrite").parquet(f"{root}/digests/snapshot_ts={snapshot_ts}")


def differing_buckets(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """``what, bucket`` of two saved graphs, from their digests alone."""
    read = spark.read.schema(_DIGEST)
    sides = [read.parquet(f"{root}/digests/snapshot_ts={at}") for at in (old, new)]
    return sides[0].exceptAll(sides[1]).union(sides[1].exceptAll(sides[0])).select("what", "bucket").distinct()


def stored_graphs_equal(spark: SparkSession, root: str, old: int, new: int) -> DataFrame:
    """One row: ``equal``, and how many buckets of vertices and edges differ."""
    found = differing_buckets(spark, root, old, new)
    return found.agg(
        (F.count("*") == 0).alias("equal"),
        F.count_if(F.col("what") == "vertices").alias("vertex_buckets"),
        F.count_if(F.col("what") == "edges").alias("edge_buckets"))


def stored_diff(spark: SparkSession, root: str, old: int, new: int, what: str = "edges") -> DataFrame:
    """``change`` and the columns of the rows added and removed from one saved graph to
    another. Only the buckets that differ are read."""
    columns, schema = _TABLES[what]
    buckets = [  # as many as there are buckets at most
        r["bucket"] for r in differing_buckets(spark, root, old, new).filter(F.col("what") == what).collect()]
    sides = [
        spark.read.schema(_with_bucket(schema)).parquet(f"{root}/rows/{what}/snapshot_ts={at}")
        .filter(F.col("bucket").isin(buckets)) for at in (old, new)]
    change = F.when(F.col("n_left") == 0, "added").when(F.col("n_right") == 0, "removed")
    return (
        side_counts(*sides, columns).withColumn("change", change)
        .filter(F.col("change").isNotNull()).select("change", *columns)
    )
