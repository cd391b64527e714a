"""Streaming queries over commands, messages and texts.

Each takes a streaming DataFrame from any source (files, socket, Kafka, rate)
and returns a started query. ``trigger`` is passed on to Spark, for example
``{"processingTime": "15 seconds"}`` or ``{"availableNow": True}``.
"""

from __future__ import annotations

import datetime as dt
import time
from collections import deque
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidegraph.functions.times import epoch_micros
from tidegraph.model import ADD_EDGE, EDGE_KEY, RMV_EDGE
from tidegraph.operators.tweets import count_messages, word_counts
from tidegraph.sources.commands import (
    file_number,
    parse_commands,
    parse_load_requests,
    read_lines,
    read_numbered_batches,
    with_line_no,
)
from tidegraph.sources.snapshots import write_snapshot
from tidegraph.streaming.store import GraphStore

# Polling and batch intervals of the known deployments.
BATCH_INTERVAL = {"processingTime": "15 seconds"}
TICK = {"processingTime": "5 seconds"}

_EVENT_TIME = "_event_time"
_LINES_PER_BATCH = Decimal(1 << 63)  # line numbers are longs


def tick_number(df: DataFrame, ts_col: str = "ts", seconds: int = 5) -> Column:
    """The number of the tumbling event-time batch a row falls into."""
    return F.floor(epoch_micros(df, ts_col) / (seconds * 1_000_000))


def with_tick_batches(commands: DataFrame, seconds: int = 5, ts_col: str = "ts") -> DataFrame:
    """Commands with ``batch_id`` set from their own clock, batch or stream."""
    return commands.withColumn("batch_id", tick_number(commands, ts_col, seconds))


def run_graph(
    commands: DataFrame,
    store: GraphStore,
    checkpoint: str,
    trigger: dict | None = None,
    reduce_first: bool = False,
    compact_every: int | None = None,
    after_batch: Callable[[GraphStore, int], None] | None = None,
    lateness: str | None = None,
    ttl_seconds: int | None = None,
    key_at: Callable[[dt.datetime], int] | None = None,
) -> StreamingQuery:
    """Keep a stored graph up to date with a stream of commands.

    ``reduce_first`` applies the commands of a batch in the order of their
    lines: each batch counts with its net effect. Marks are then kept by batch
    and line, so that a batch may be spread over micro-batches in any way. It
    needs a ``seq`` column or the file columns to derive one from.

    With ``compact_every`` the marks are merged that often; deltas a base holds
    and all but the last two bases are deleted. Empty micro-batches are skipped. A
    micro-batch that runs again after a failure replaces what its first run stored.

    With ``lateness`` the query has a watermark on ``ts``, and compaction collects
    what it has passed: edges not added for ``ttl_seconds`` before it, and, if
    ``key_at`` tells the first order key that can come at a moment or later, removals
    and removed edges older than that. Commands with older keys are then refused.
    The watermark is read from the query's own progress, so it is that of the
    micro-batch before, or earlier.
    """
    started: list[StreamingQuery] = []
    if lateness is not None:
        commands = commands.withColumn(_EVENT_TIME, F.col("ts").cast("timestamp")).withWatermark(
            _EVENT_TIME, lateness)

    def compact(number: int) -> None:
        passed = _watermark(started[0]) if started and lateness is not None else None
        if passed is None:
            store.compact(number)
            return
        as_of = F.to_timestamp(F.lit(passed.isoformat())).cast(store.ts_type)
        store.compact(
            number,
            settled=key_at(passed) if key_at is not None else None,
            as_of=as_of if ttl_seconds is not None else None,
            ttl_seconds=ttl_seconds,
        )

    def store_batch(batch: DataFrame, number: int) -> None:
        batch = batch.drop(_EVENT_TIME)
        if reduce_first:
            if "seq" not in batch.columns:
                batch = with_line_no(batch).withColumnRenamed("line_no", "seq")
            batch = _by_line(batch)
        # Edge and vertex marks both read it; a lost part is read again.
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            store.append(batch, number)
        finally:
            batch.unpersist()
        if compact_every and (number + 1) % compact_every == 0:
            compact(number)
            store.prune(keep_bases=2)
        if after_batch is not None:
            after_batch(store, number)

    query = (
        commands.writeStream.queryName("graph")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or BATCH_INTERVAL))
        .foreachBatch(store_batch)
        .start()
    )
    started.append(query)
    return query


def _watermark(query: StreamingQuery) -> dt.datetime | None:
    """The moment a query's last finished micro-batch had passed, in UTC."""
    progress = query.lastProgress
    told = (progress["eventTime"] or {}).get("watermark") if progress else None
    moment = dt.datetime.fromisoformat(told) if told else None
    return None if moment is None or moment.timestamp() <= 0 else moment


def run_replay(
    files: DataFrame,
    store: GraphStore,
    checkpoint: str,
    trigger: dict | None = None,
    ordered: bool = False,
    compact_every: int | None = None,
    after_batch: Callable[[GraphStore, int], None] | None = None,
    count_into: str | None = None,
) -> StreamingQuery:
    """Keep a stored graph up to date with :func:`sources.replay.numbered_files`.

    The file number is the batch; with ``ordered`` the lines of a file apply in
    their order. Files are disposed of by the source, once their micro-batch has
    been committed.

    With ``count_into``, a folder, the counts after each file are written there by
    micro-batch, for :func:`count_series_of`; files must not apply line by line then.
    """
    if count_into is not None:
        if ordered:
            raise ValueError("counts after each file need files that apply as a whole")
        fs, path = store._fs(count_into)
        fs.mkdirs(path)

    def store_batch(batch: DataFrame, number: int) -> None:
        files = batch.collect()  # as many as the source's filesPerBatch
        paths = [r["path"] for r in files]
        if not paths:
            return
        commands = read_numbered_batches(batch.sparkSession, paths)
        again = number <= store.manifest().pruned  # then its counts were written before
        store.append(_by_line(commands) if ordered else commands, number)
        if count_into is not None and not again:
            numbers = batch.sparkSession.createDataFrame([(r["number"],) for r in files], "batch_id long")
            store.counts_within(commands, number, numbers).write.mode("overwrite").parquet(
                f"{count_into}/update={number}")
        if compact_every and (number + 1) % compact_every == 0:
            store.compact(number)
            store.prune(keep_bases=2)
        if after_batch is not None:
            after_batch(store, number)

    return (
        files.writeStream.queryName("replay")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TICK))
        .foreachBatch(store_batch)
        .start()
    )


def run_branching(
    files: DataFrame,
    store: GraphStore,
    checkpoint: str,
    trigger: dict | None = None,
    after_batch: Callable[[GraphStore, int], None] | None = None,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Replay :func:`sources.replay.numbered_files` line by line; a line ``loadOld
    yyyy-MM-dd HH:mm:ss`` makes the saved graph nearest to that time the current one.

    What follows it goes on from that graph. A request before anything is saved, or
    with a malformed time, changes nothing. The store must keep the ordered mode.
    Each request splits its micro-batch, so the driver sees the requests, not commands.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # as many as the source's filesPerBatch
        if not paths:
            return
        lines = read_lines(batch.sparkSession, paths).withColumn(
            "batch_id", file_number(F.col("file_name"))).withColumnRenamed("line_no", "seq")
        lines = _by_line(lines)
        requests = parse_load_requests(lines).filter("at_millis is not null").orderBy("seq").collect()
        commands = parse_commands(lines)
        steps: list = []
        since = None
        for request in requests:
            part = commands.filter(F.col("seq") < request["seq"])
            steps += [part if since is None else part.filter(F.col("seq") > since), request["at_millis"]]
            since = request["seq"]
        steps.append(commands if since is None else commands.filter(F.col("seq") > since))
        store.append_steps(steps, number)
        if compact_every and (number + 1) % compact_every == 0 and (deltas := store.deltas()):
            store.compact(deltas[-1])
            store.prune(keep_bases=2)
        if after_batch is not None:
            after_batch(store, number)

    return (
        files.writeStream.queryName("branches")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TICK))
        .foreachBatch(store_batch)
        .start()
    )


def _by_line(commands: DataFrame) -> DataFrame:
    """Commands whose order key, in either mode, is their batch and line."""
    key = (F.col("batch_id") * F.lit(_LINES_PER_BATCH) + F.col("seq")).cast("decimal(38,0)")
    return commands.withColumn("seq", key).withColumn("batch_id", key)


def until_caught_up(query: StreamingQuery) -> None:
    """Let a query take what its source has now, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def count_series_of(spark: SparkSession, folder: str) -> DataFrame:
    """``batch_id, n_edges, n_vertices`` of the counts that :func:`run_replay` wrote."""
    kept = "batch_id long, n_edges long, n_vertices long"
    return spark.read.schema(kept).parquet(folder).select("batch_id", "n_edges", "n_vertices")


def save_each_batch(root: str, every: int = 1) -> Callable[[GraphStore, int], None]:
    """For ``after_batch``: save the graph under the current time."""

    def save(store: GraphStore, number: int) -> None:
        if (number + 1) % every == 0:
            write_snapshot(store.graph(), root, int(time.time() * 1000))

    return save


def expiry_stream(commands: DataFrame, ttl_seconds: int, lateness: str) -> DataFrame:
    """``rmvEdge`` commands for edges that are not added again in time.

    The additions of an edge form sessions whose gap is the time to live; a
    session that closes is an edge that expires, at the moment its last
    addition is that old. An addition exactly that old still refreshes, hence
    the extra microsecond. Sessions are dropped once the watermark has passed
    them, so state holds living edges only; where the session is built by
    ``build_session`` they are merged before the shuffle too, so that an edge
    added all the time sends one row per task.

    Spark keeps event time with a time zone; commands stamped without one come
    back the same way (exactly so in sessions without daylight saving).
    """
    kind = commands.schema["ts"].dataType
    micros = ttl_seconds * 1_000_000 + 1
    session = F.session_window("ts", f"{micros} microseconds")
    return (
        commands.filter(F.col("op") == ADD_EDGE)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(session, *EDGE_KEY)
        .agg(F.count("*").alias("n_adds"))
        .select(
            (F.col("session_window.end") - F.expr("INTERVAL '0.000001' SECOND"))
            .cast(kind)
            .alias("ts"),
            F.lit(RMV_EDGE).alias("op"),
            *EDGE_KEY,
        )
    )


def run_expiry(
    commands: DataFrame,
    ttl_seconds: int,
    lateness: str,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the commands of :func:`expiry_stream` as parquet."""
    return (
        expiry_stream(commands, ttl_seconds, lateness)
        .writeStream.queryName("expiry")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TICK))
        .format("parquet")
        .start(path)
    )


def run_raw_sink(
    lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write every line seen in an interval to files, copies kept."""
    return (
        lines.select("value")
        .writeStream.queryName("raw")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TICK))
        .format("text")
        .start(path)
    )


def run_word_counts(
    texts: DataFrame,
    publish: Callable[[DataFrame, int], None],
    checkpoint: str,
    text_col: str = "text",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Publish ``word|count`` messages of the words whose count changed."""
    return (
        word_counts(texts, text_col)
        .writeStream.queryName("words")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TICK))
        .foreachBatch(lambda counts, number: publish(count_messages(counts), number))
        .start()
    )


def observed(commands: DataFrame, name: str = "commands") -> DataFrame:
    """Commands with per-micro-batch metrics attached, counted on the way."""
    return commands.observe(
        name,
        F.count(F.lit(1)).alias("n_commands"),
        F.count_if(F.col("op") == ADD_EDGE).alias("n_add_edge"),
        F.max("batch_id").alias("last_batch"),
    )


class BatchMetrics(StreamingQueryListener):
    """Keeps a record of each of the last micro-batches that had input."""

    def __init__(self, keep: int = 1000) -> None:
        self.records: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.numInputRows:
            self.records.append(
                {
                    "query": progress.name,
                    "batch": progress.batchId,
                    "rows": progress.numInputRows,
                    "build_ms": progress.batchDuration,
                    **{
                        key: value
                        for row in progress.observedMetrics.values()
                        for key, value in row.asDict().items()
                    },
                }
            )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
