"""Queries over text files: written, numbered, framed, and replayed as streams.

Each writes the commands of the ``events`` table as text first.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.times import epoch_millis
from tidegraph.operators import marks
from tidegraph.plans import command_queries, graph_queries  # noqa: F401 - their SQL is used here
from tidegraph.plans.catalog import ORACLES, query
from tidegraph.plans.sql import AS_OF, COMMANDS, TTL_SECONDS, ctes, graph, kept_edges
from tidegraph.plans.stream_queries import BUCKETS, MICRO_BATCHES, _CAUGHT_UP, _events_in_files
from tidegraph.plans.time_queries import scratch_folder
from tidegraph.sources import commands as lines_in
from tidegraph.sources import replay
from tidegraph.sources.tables import event_commands
from tidegraph.streaming import jobs
from tidegraph.streaming.frames import FrameStore, run_frames
from tidegraph.streaming.store import GraphStore

_FRAMED_SQL = ORACLES["framed_batches"].split("numbered as (")[0].rstrip().removesuffix(",")


def write_numbered(lines: DataFrame, folder: str, number: str, order: str) -> str:
    """Text files ``0.txt, 1.txt …`` of ``value``, each in order."""
    spark = lines.sparkSession
    (
        lines.repartition(number).sortWithinPartitions(number, order)
        .select(F.col(number).alias("number"), "value")
        .write.partitionBy("number").text(f"{folder}/parts")
    )
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/in"))
    parts = fs.globStatus(path(f"{folder}/parts/number=*/part-*"))

    def rename(part) -> None:
        n = part.getPath().getParent().getName().removeprefix("number=")
        fs.rename(part.getPath(), path(f"{folder}/in/{n}.txt"))

    with ThreadPoolExecutor(8) as threads:
        list(threads.map(rename, parts))
    return f"{folder}/in"


def _files_a_batch(spark: SparkSession, folder: str, least: int) -> int:
    """How many files a micro-batch takes, so that however many wait are dealt to
    ``MICRO_BATCHES`` at most: each has its price, whatever it holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(least, -(-len(fs.listStatus(path)) // MICRO_BATCHES))


def _batch_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    texts = lines_in.format_commands(event_commands(spark, sf_dir))
    return write_numbered(texts, folder, "batch_id", "seq")


@query(ctes(COMMANDS, graph("batch")) + "select src, dst, attr from edges")
def numbered_files_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by their batch, folded batch by batch."""
    folder = _batch_files(spark, sf_dir, scratch_folder(spark, "numbered-files"))
    return marks.build_graph(lines_in.read_numbered_batches(spark, folder), "batch").edges


@query(ctes(COMMANDS, graph("ordered")) + "select id, attr from vertices")
def numbered_files_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by their batch, line by line."""
    folder = _batch_files(spark, sf_dir, scratch_folder(spark, "numbered-lines"))
    commands = jobs._by_line(lines_in.read_numbered_batches(spark, folder))
    return marks.build_graph(commands, "ordered").vertices


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def replayed_files_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files replayed by number, line by line, and deleted as they are committed."""
    folder = scratch_folder(spark, "replayed-files")
    path = _batch_files(spark, sf_dir, folder)
    files = replay.numbered_files(
        spark, path, filesPerBatch=_files_a_batch(spark, path, 3), dispose="delete")
    store = GraphStore(spark, f"{folder}/marks", "ordered", buckets=BUCKETS)
    jobs.until_caught_up(jobs.run_replay(
        files, store, f"{folder}/progress", {"processingTime": "0 seconds"}, ordered=True, compact_every=2))
    return store.graph().edges


@query(ORACLES["count_series"])
def streamed_count_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after each batch, kept up to date and never counted anew."""
    folder = scratch_folder(spark, "counted-stream")
    path = _batch_files(spark, sf_dir, folder)
    files = replay.numbered_files(spark, path, filesPerBatch=_files_a_batch(spark, path, 1))
    store = GraphStore(spark, f"{folder}/marks", "batch", buckets=BUCKETS)
    jobs.until_caught_up(jobs.run_replay(
        files, store, f"{folder}/progress", {"processingTime": "0 seconds"}, compact_every=4,
        count_into=f"{folder}/series"))
    return jobs.count_series_of(spark, f"{folder}/series")


_DAY = 86_400


@query(
    ctes(
        COMMANDS,
        f"""ticked as (select * replace (cast(floor(epoch_us(ts) / {_DAY}e6) as bigint) as batch_id)
  from commands where ts <= timestamp '{AS_OF}')""",
        kept_edges("batch", "ticked"),
    )
    + f"""select src, dst, attr from kept_edges
group by src, attr, dst having max(ts) + interval '{TTL_SECONDS} seconds' >= timestamp '{AS_OF}'"""
)
def streamed_collected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running graph that forgets what its watermark has passed."""
    folder = scratch_folder(spark, "collected")
    now = F.expr(f"timestamp_ntz '{AS_OF}'")
    store = GraphStore(spark, f"{folder}/marks", "batch", buckets=BUCKETS)
    stream = jobs.with_tick_batches(
        _events_in_files(spark, sf_dir, folder).filter(F.col("ts") <= now), _DAY)
    jobs.run_graph(
        stream, store, f"{folder}/progress", _CAUGHT_UP, compact_every=2, lateness="40 days",
        ttl_seconds=TTL_SECONDS, key_at=lambda at: int(at.timestamp()) // _DAY,
    ).awaitTermination()
    return store.graph(as_of=now, ttl_seconds=TTL_SECONDS).edges


@query(
    ORACLES["framed_batches"].split("select f.line_no as seq")[0]
    + """select r.batch_id, r.frame_batch, r.frame_id, f.file, cast(f.frame as bigint) as frame,
  f.value as line
from framed f join ranked r on f.file = r.file and f.frame = r.frame
where f.value like 'add%' or f.value like 'rmv%'"""
)
def framed_files_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in numbered files."""
    folder = scratch_folder(spark, "framed-files")
    lines = command_queries._framed_lines(spark, sf_dir)
    path = write_numbered(lines.withColumnRenamed("file", "n"), folder, "n", "line_no")
    read = lines_in.read_lines(spark, path).withColumn("number", lines_in.file_number(F.col("file_name")))
    rows = lines_in.read_frames_as_batches(read, file_col="number")
    return lines_in.format_commands(rows).select(
        "batch_id", "frame_batch", "frame_id", F.col("number").alias("file"), "frame",
        F.col("value").alias("line"))


@query(
    _FRAMED_SQL
    + """,
numbered as (
  select *, coalesce(sum((value = 'END_OF_FILE')::int) over (
      order by line_no rows between unbounded preceding and 1 preceding), 0) as frame,
    sum((value = 'END_OF_FILE')::int) over () as frames
  from lines),
framed as (select * from numbered where frame < frames),
headers as (
  select frame, arg_max(value, line_no) as header from framed where value like 'FILE_INFO %' group by frame)
select cast(f.frame as bigint) as frame,
  coalesce(cast(string_split(h.header, ' ')[2] as bigint), 0) as frame_id,
  coalesce(cast(string_split(h.header, ' ')[3] as bigint), 0) as frame_batch, f.value as line
from framed f left join headers h on f.frame = h.frame
where f.value like 'add%' or f.value like 'rmv%'"""
)
def streamed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that go on over files and micro-batches, handed on when they end."""
    folder = scratch_folder(spark, "framed-stream")
    # cut where it falls, so that files end inside frames
    lines = command_queries._framed_lines(spark, sf_dir).withColumn("n", F.expr("line_no div 3333"))
    path = write_numbered(lines, folder, "n", "line_no")

    def publish(frames: DataFrame, number: int) -> None:
        frames.write.mode("overwrite").parquet(f"{folder}/out/update={number}")

    jobs.until_caught_up(run_frames(
        replay.numbered_files(spark, path, filesPerBatch=_files_a_batch(spark, path, 4)), FrameStore(spark, f"{folder}/frames"), publish,
        f"{folder}/progress", {"processingTime": "0 seconds"}))
    return spark.read.parquet(f"{folder}/out").select("frame", "frame_id", "frame_batch", F.col("value").alias("line"))


# Ten files; every file but the first saves its graph when it has been applied, under
# the time of its last command. Requests stand at the head of the sixth and the ninth.
_BRANCHES = """filed as (
  select *, seq * 10 // (select max(seq) + 1 from commands) as file from commands),
saves as (select file, epoch_us(max(ts)) // 1000 as at from filed where file > 0 group by file),
asked as (
  select 5 as file, epoch_us(date_trunc('second', min(ts))) // 1000 as at from filed where file = 2
  union all
  select 8, epoch_us(date_trunc('second', min(ts))) // 1000 from filed where file = 7),
chosen as (
  select a.file, (select s.file from saves s where s.file < a.file order by abs(s.at - a.at), s.at limit 1) as back
  from asked a),
-- what the second request goes back to has itself gone back to the first one's choice
kept as (
  select f.* from filed f, (select back from chosen where file = 5) x, (select back from chosen where file = 8) y
  where f.file >= 8
    or (y.back >= 5 and (f.file <= x.back or f.file between 5 and y.back))
    or (y.back < 5 and f.file <= y.back))"""


@query(ctes(COMMANDS, _BRANCHES, graph("ordered", "kept")) + "select src, dst, attr from edges")
def streamed_load_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests for a saved graph among the commands."""
    folder = scratch_folder(spark, "branches")
    commands = event_commands(spark, sf_dir)
    most = commands.agg(F.max("seq")).first()[0] + 1
    texts = lines_in.format_commands(commands).withColumn("n", F.expr(f"seq * 10 div {most}"))
    times = texts.groupBy("n").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    asked = times.filter("n in (2, 7)").select(
        F.expr("case n when 2 then 5L else 8L end").alias("n"), F.lit(-1).cast("long").alias("seq"),
        F.concat(F.lit("loadOld "), F.date_format("first", "yyyy-MM-dd HH:mm:ss")).alias("value"))
    path = write_numbered(texts.select("n", "seq", "value").unionByName(asked), folder, "n", "seq")
    saved_at = {r["n"]: r["at"] for r in times.select("n", epoch_millis(times, "last").alias("at")).collect()}
    store = GraphStore(spark, f"{folder}/marks", "ordered", buckets=BUCKETS)

    def save(store: GraphStore, number: int) -> None:
        if number > 0:
            store.save(saved_at[number])

    jobs.until_caught_up(jobs.run_branching(
        replay.numbered_files(spark, path), store, f"{folder}/progress", {"processingTime": "0 seconds"}, save,
        compact_every=3))
    return store.graph().edges
