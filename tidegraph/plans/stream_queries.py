"""Queries that run as streams over the tables and return what they left.

Each reads its table through a file stream until it has caught up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import tweets as words
from tidegraph.plans.catalog import query
from tidegraph.plans.message_queries import _WORDS
from tidegraph.plans.sql import AS_OF, COMMANDS, TTL_SECONDS, before, ctes, graph, kept_edges
from tidegraph.plans.time_queries import scratch_folder
from tidegraph.sources import tables
from tidegraph.sources.commands import format_commands
from tidegraph.streaming import jobs
from tidegraph.streaming.store import GraphStore

_CAUGHT_UP = {"availableNow": True}
BUCKETS = 8  # of a store of one run over one table
MICRO_BATCHES = 12  # of a replay of many files, at most


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # as a pattern, since a stream's plain path must be a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def _command_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.as_commands(_stream(spark, sf_dir, "events"))


def _streamed_graph(spark: SparkSession, sf_dir: str, mode: str):
    folder = scratch_folder(spark, "graph-stream")
    store = GraphStore(spark, f"{folder}/marks", mode, buckets=BUCKETS)
    stream = _command_stream(spark, sf_dir)
    jobs.run_graph(stream, store, f"{folder}/progress", _CAUGHT_UP).awaitTermination()
    return store.graph()


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def streamed_edges_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_graph(spark, sf_dir, "ordered").edges


@query(ctes(COMMANDS, graph("batch")) + "select id, attr from vertices")
def streamed_vertices_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_graph(spark, sf_dir, "batch").vertices


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def streamed_reduced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "reduced-stream")
    store = GraphStore(spark, f"{folder}/marks", "batch", buckets=BUCKETS)
    jobs.run_graph(
        _command_stream(spark, sf_dir),
        store,
        f"{folder}/progress",
        _CAUGHT_UP,
        reduce_first=True,
        compact_every=1,
    ).awaitTermination()
    return store.graph().edges


def _events_in_files(spark: SparkSession, sf_dir: str, folder: str, *deal: str) -> DataFrame:
    """The commands as a stream of eight files, one to a micro-batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    dealt = events.repartition(8, *deal) if deal else events.repartitionByRange(8, "event_id")
    dealt.write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return tables.as_commands(stream.parquet(f"{folder}/in"))


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def streamed_edges_many_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several micro-batches, merged over bases that are compacted and pruned."""
    folder = scratch_folder(spark, "many-batches")
    store = GraphStore(spark, f"{folder}/marks", "ordered", buckets=BUCKETS)
    jobs.run_graph(
        _events_in_files(spark, sf_dir, folder), store, f"{folder}/progress", _CAUGHT_UP, compact_every=3
    ).awaitTermination()
    return store.graph().edges


@query(ctes(COMMANDS, graph("batch")) + "select src, dst, attr from edges")
def streamed_late_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every micro-batch has commands of batches early and late."""
    folder = scratch_folder(spark, "late-batches")
    store = GraphStore(spark, f"{folder}/marks", "batch", buckets=BUCKETS)
    jobs.run_graph(
        _events_in_files(spark, sf_dir, folder, "event_type"),
        store, f"{folder}/progress", _CAUGHT_UP, compact_every=3,
    ).awaitTermination()
    return store.graph().edges


@query(ctes(COMMANDS, graph("ordered")) + "select id, attr from vertices")
def streamed_split_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each batch are spread over micro-batches and still apply in
    their order."""
    folder = scratch_folder(spark, "split-batch")
    store = GraphStore(spark, f"{folder}/marks", "batch", buckets=BUCKETS)
    jobs.run_graph(
        _events_in_files(spark, sf_dir, folder, "event_id"), store, f"{folder}/progress", _CAUGHT_UP,
        reduce_first=True, compact_every=4,
    ).awaitTermination()
    return store.graph().vertices


@query(
    ctes(COMMANDS, before(), kept_edges("ordered", "before"))
    + f"""select src, dst, attr from kept_edges
group by src, attr, dst having max(ts) + interval '{TTL_SECONDS} seconds' >= timestamp '{AS_OF}'"""
)
def streamed_edges_with_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aged edges leave the running graph."""
    folder = scratch_folder(spark, "expiring")
    now = F.expr(f"timestamp_ntz '{AS_OF}'")
    store = GraphStore(spark, f"{folder}/marks", "ordered", buckets=BUCKETS)
    stream = _events_in_files(spark, sf_dir, folder).filter(F.col("ts") <= now)
    jobs.run_graph(stream, store, f"{folder}/progress", _CAUGHT_UP, compact_every=3).awaitTermination()
    return store.graph(as_of=now, ttl_seconds=TTL_SECONDS).edges


@query(
    ctes(
        COMMANDS,
        f"""gaps as (
  select src, attr, dst, ts + interval '{TTL_SECONDS} seconds' as due,
    lead(ts) over (partition by src, attr, dst order by ts) as next_ts
  from commands where op = 'addEdge')""",
    )
    + """select due as ts, 'rmvEdge' as op, src, attr, dst from gaps
where (next_ts is null or next_ts > due)
  and due < (select date_trunc('milliseconds', max(ts)) from commands where op = 'addEdge')"""
)
def streamed_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "expiry-stream")
    jobs.run_expiry(
        _command_stream(spark, sf_dir),
        TTL_SECONDS,
        "0 seconds",
        f"{folder}/out",
        f"{folder}/progress",
        _CAUGHT_UP,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(ctes(_WORDS) + "select word || '|' || n as message from words")
def streamed_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "word-stream")

    def publish(messages: DataFrame, number: int) -> None:
        messages.write.mode("overwrite").text(f"{folder}/messages/update={number}")

    jobs.run_word_counts(
        _stream(spark, sf_dir, "documents"), publish, f"{folder}/progress", trigger=_CAUGHT_UP
    ).awaitTermination()
    published = spark.read.text(f"{folder}/messages")
    return words.latest_messages(published, "value", "update")


@query(
    ctes(COMMANDS)
    + """select op || ' ' || src || case when op in ('addEdge', 'rmvEdge')
    then ' ' || attr || ' ' || dst else '' end as value from commands"""
)
def streamed_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "raw-stream")
    lines = format_commands(_command_stream(spark, sf_dir))
    jobs.run_raw_sink(lines, f"{folder}/out", f"{folder}/progress", _CAUGHT_UP).awaitTermination()
    return spark.read.text(f"{folder}/out")


@query(
    ctes(COMMANDS)
    + """select cast(floor(epoch_us(ts) / 5000000.0) as bigint) as batch_id, cast(count(*) as bigint) as n
from commands group by 1"""
)
def tick_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticked = jobs.with_tick_batches(tables.event_commands(spark, sf_dir))
    return ticked.groupBy("batch_id").agg(F.count("*").alias("n"))
