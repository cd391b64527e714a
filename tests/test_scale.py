"""Plans must hold when one key has most of the rows."""

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import compare, generate, marks, series
from tidegraph.operators import graph as ops

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hub(spark, tmp_path_factory):
    """Commands of which a third add an edge from one vertex, stored."""
    path = str(tmp_path_factory.mktemp("hub") / "commands")
    rows = generate.generate(spark, 300_000, generate.GROWTH, seed=1, batch_size=50_000)
    third = (F.col("seq") % 3 == 0) & (F.col("op") == "addEdge")
    (
        rows.withColumn("src", F.when(third, 7).otherwise(F.col("src")))
        .withColumn("dst", F.when(third, F.col("seq") + 1_000_000).otherwise(F.col("dst")))
        .repartition(8)
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def final_plan(df):
    """The executed plan after adaptive execution has finished."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_a_hub_is_split_in_the_endpoint_joins(spark, no_broadcast, hub):
    edges = marks.build_graph(hub, "batch").edges
    assert "skew=true" in final_plan(edges)


def test_a_hub_is_split_when_removing_and_matching(spark, no_broadcast, hub):
    edges, gone = ops.edges_of(hub, "addEdge"), ops.nodes_of(hub, "rmvNode")
    assert "skew=true" in final_plan(ops.remove_incident_edges(edges, gone))
    keys = gone.select(F.col("id").alias("src"))
    assert "skew=true" in final_plan(compare.matching_keys(edges, keys, "src"))
    assert "skew=true" in final_plan(ops.triplets(ops.graph_from_edges(edges)))
    copies, listed = edges.select("src", "attr"), ops.edges_of(hub, "rmvEdge").select("src", "attr")
    # Rows all alike compress too well to count as skewed here; splitting needs
    # both sides shuffled for the join, besides the shuffle that drops copies.
    plan = final_plan(compare.bag_difference(copies, listed))
    assert plan.count("Exchange hashpartitioning") == 3


def test_filters_and_columns_reach_the_scan(spark, hub):
    plan = marks.build_graph(hub, "batch").edges._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(op,rmvNode)" in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    removals = [line for line in scans if "EqualTo(op,rmvNode)" in line]
    assert removals and all("ReadSchema: struct<batch_id:bigint,op:string,src:bigint>" in line for line in removals)
    assert not any("seq:bigint" in line for line in scans)


def test_few_removals_leave_one_shuffle(spark, hub):
    edges = marks.build_graph(hub, "batch", prune_early=True).edges
    plan = final_plan(edges)
    moved = [
        line for line in plan.splitlines() if "Exchange hashpartitioning(src" in line and "attr" in line
    ]
    assert len(moved) == 1 and "SortMergeJoin" not in plan


def test_series_reads_shared_shuffles(spark, no_broadcast, hub):
    """One pass over edges, vertices and batches each, however often used."""
    plan = final_plan(series.count_series(hub))
    assert plan.count("FileScan parquet") == 3


def test_a_hub_is_split_when_copies_are_counted(spark, no_broadcast, hub):
    copies = series.vertex_copies(hub, "ordered")
    assert "skew=true" in final_plan(copies)
    assert "skew=true" in final_plan(series.edge_copies(hub, "ordered"))
