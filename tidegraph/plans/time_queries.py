"""Queries on moments: saved graphs, graphs as of a time, expiry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.times import epoch_millis, parse_request_time
from tidegraph.operators import expiry, marks, temporal
from tidegraph.plans.catalog import query
from tidegraph.plans.sql import AS_OF, COMMANDS, TTL_SECONDS, before, ctes, graph, kept_edges
from tidegraph.session import ensure_checkpoint_dir
from tidegraph.sources import commands as lines_io
from tidegraph.sources import snapshots
from tidegraph.sources.tables import event_commands, table

_AT = f"TIMESTAMP_NTZ '{AS_OF}'"
_AT_MILLIS = f"epoch_ms(timestamp '{AS_OF}')"

# Every batch saves a graph when it ends, beside a folder that is no snapshot.
_SAVED = """saved as (
  select epoch_us(max(ts)) // 1000 as snapshot_ts from commands group by batch_id)"""


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _saved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    ends = c.groupBy("batch_id").agg(F.max("ts").alias("ts"))
    number = epoch_millis(ends, "ts").cast("string")
    return ends.select(
        F.explode(F.array(number, F.concat(F.lit("run"), F.col("batch_id").cast("string")))).alias("name")
    )


@query(
    ctes(COMMANDS, _SAVED)
    + f"""select cast(snapshot_ts as varchar) as name, snapshot_ts,
  abs(snapshot_ts - {_AT_MILLIS}) as distance
from saved order by distance, snapshot_ts limit 1"""
)
def nearest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.nearest_snapshot(_saved_names(spark, sf_dir), parse_request_time(F.lit(AS_OF)))


@query(
    ctes(COMMANDS, _SAVED)
    + """select seq, (select s.snapshot_ts from saved s
  order by abs(s.snapshot_ts - epoch_us(c.ts) // 1000), s.snapshot_ts limit 1) as nearest_ts
from commands c"""
)
def nearest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    probes = c.select("seq", epoch_millis(c, "ts").alias("at"))
    saved = temporal.snapshot_times(_saved_names(spark, sf_dir))
    return temporal.nearest_snapshots(probes, "at", saved).select("seq", "nearest_ts")


@query(
    """select event_id, epoch_ms(date_trunc('second', ts)) as at_millis from events
union all select -1 - event_id, null from events"""
)
def request_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    good = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("asked"))
    bad = e.select((-1 - F.col("event_id")).alias("event_id"), F.col("event_type").alias("asked"))
    return good.unionByName(bad).select(
        "event_id", parse_request_time(F.col("asked")).alias("at_millis")
    )


@query("select event_id, epoch_ms(date_trunc('second', ts)) as at_millis from events")
def load_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    asked = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    lines = e.select(
        "event_id",
        F.explode(F.array(F.concat(F.lit(" loadOld "), asked), F.concat(F.lit("addNode "), "event_id"))).alias("value"),
    )
    return lines_io.parse_load_requests(lines).select("event_id", "at_millis")


@query(ctes(COMMANDS, before(), graph("ordered", "before")) + "select src, dst, attr from edges")
def edges_as_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.graph_as_of_time(event_commands(spark, sf_dir), F.expr(_AT)).edges


@query(ctes(COMMANDS, before(), graph("ordered", "before")) + "select id, attr from vertices")
def vertices_as_of_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.graph_as_of_time(event_commands(spark, sf_dir), F.expr(_AT)).vertices


@query(
    ctes(COMMANDS, "early as (select * from commands where batch_id <= 4)", graph("batch", "early"))
    + "select src, dst, attr from edges"
)
def edges_as_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.graph_as_of_batch(event_commands(spark, sf_dir), 4).edges


@query(
    ctes(COMMANDS, "early as (select * from commands where seq <= 777)", graph("ordered", "early"))
    + "select src, dst, attr from edges"
)
def edges_as_of_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.graph_as_of_seq(event_commands(spark, sf_dir), 777).edges


# --- saved graphs ------------------------------------------------------------


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def snapshot_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_folder(spark, "text-snapshot")
    built = marks.build_graph(event_commands(spark, sf_dir), "ordered")
    snapshots.write_snapshot_text(built, root, "saved")
    return snapshots.read_snapshot_text(spark, root, "saved").edges


@query(ctes(COMMANDS, graph("batch")) + "select id, attr from vertices")
def snapshot_vertices_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_folder(spark, "text-snapshot")
    built = marks.build_graph(event_commands(spark, sf_dir), "batch")
    snapshots.write_snapshot_text(built, root, "saved")
    return snapshots.read_snapshot_text(spark, root, "saved").vertices


def _saved_graphs(spark: SparkSession, sf_dir: str):
    c = event_commands(spark, sf_dir)
    root = scratch_folder(spark, "snapshots")
    at = spark.range(1).select(parse_request_time(F.lit(AS_OF)).alias("at")).first()["at"]
    snapshots.write_snapshot(temporal.graph_as_of_time(c, F.expr(_AT)), root, at)
    snapshots.write_snapshot(marks.build_graph(c, "ordered"), root, at + 86_400_000)
    return root, at


@query(ctes(COMMANDS, before(), graph("ordered", "before")) + "select src, dst, attr from edges")
def load_old_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, at = _saved_graphs(spark, sf_dir)
    return snapshots.load_old(spark, root, at + 3_600_000).edges


@query(ctes(COMMANDS, before(), graph("ordered", "before")) + "select id, attr from vertices")
def load_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, at = _saved_graphs(spark, sf_dir)
    return snapshots.load_old(spark, root, at + 3_600_000).vertices


@query(ctes(COMMANDS) + "select distinct batch_id, op, src, attr, dst from commands")
def stored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    path = scratch_folder(spark, "batches")
    lines_io.write_batches(c, path)
    lines_io.write_batches(c.filter(F.col("ts") > F.expr(_AT)).unionByName(c), path)
    return lines_io.read_batches(spark, path)


@query(
    ctes(COMMANDS)
    + """select op || ' ' || src || case when op in ('addEdge', 'rmvEdge')
    then ' ' || attr || ' ' || dst else '' end as value from commands"""
)
def command_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "command-text")
    lines_io.write_command_text(event_commands(spark, sf_dir), path)
    return spark.read.text(path)


# --- expiry ------------------------------------------------------------------

_TTL = f"interval '{TTL_SECONDS} seconds'"


@query(
    ctes(COMMANDS, before(), kept_edges("ordered", "before"))
    + f"""select src, attr, dst, max(ts) as last_add_ts from kept_edges
group by src, attr, dst having max(ts) + {_TTL} < timestamp '{AS_OF}'"""
)
def expired_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.expired_edges(event_commands(spark, sf_dir), TTL_SECONDS, F.expr(_AT))


@query(
    ctes(COMMANDS, before(), kept_edges("ordered", "before"))
    + f"""select src, dst, attr from kept_edges
group by src, attr, dst having max(ts) + {_TTL} >= timestamp '{AS_OF}'"""
)
def edges_with_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.graph_with_expiry(event_commands(spark, sf_dir), TTL_SECONDS, F.expr(_AT)).edges


@query(
    ctes(
        COMMANDS,
        before(),
        f"""gaps as (
  select src, attr, dst, ts + {_TTL} as due,
    lead(ts) over (partition by src, attr, dst order by ts) as next_ts
  from before where op = 'addEdge')""",
    )
    + f"""select due as ts, 'rmvEdge' as op, src, attr, dst from gaps
where (next_ts is null or next_ts > due) and due < timestamp '{AS_OF}'"""
)
def expiry_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiry.expiry_commands(event_commands(spark, sf_dir), TTL_SECONDS, F.expr(_AT))
