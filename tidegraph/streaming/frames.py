"""Frames in a stream of lines: batches that begin and end anywhere in files.

A frame is what stands before an ``END_OF_FILE`` line and after the one before it,
however many files and micro-batches it spans. A line's frame is known when the line
comes, by the ``END_OF_FILE`` lines before it, so the lines of an open frame need not
be held: each micro-batch stores its commands under the number of their frame, and
its ``FILE_INFO`` lines beside them. What is carried from one micro-batch to the next
is how many frames have been closed, and since which micro-batch the open one runs.
When its end comes, a frame is read back from the micro-batches it spans.

    root/lines/N, root/headers/N       lines of micro-batch N by frame
    root/state/N                       what micro-batch N left open
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.functions.text import computed_once, normalised
from tidegraph.model import ALL_OPS
from tidegraph.sources.commands import _ROW_BITS, FRAME_CLOSE, FRAME_OPEN, file_number, read_lines

_STATE = "number long, closed long, since long"
_HEADER = "frame long, at struct<file: bigint, line: bigint>, id long, batch long"


class FrameStore:
    """Open frames of one stream, under one folder."""

    def __init__(self, spark: SparkSession, root: str, section_lines: int = 1 << _ROW_BITS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.section_lines = section_lines

    def _state(self, before: int) -> tuple[int, int]:
        """Frames closed and the first micro-batch of the open one, as the last
        micro-batch before this one left them."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0, before
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        last = max((int(n) for n in names if n.isdigit() and int(n) < before), default=None)
        if last is None:
            return 0, before
        row = self.spark.read.schema(_STATE).parquet(f"{self.root}/state/{last}").first()
        return row["closed"], row["since"]

    def take(self, lines: DataFrame, number: int) -> DataFrame:
        """Store the lines of a micro-batch, ``(file, line, value)`` in the order of the
        first two; ``frame, frame_id, frame_batch, file, line, value`` of the commands
        of all frames it closes. Storing it again gives the same.

        Lines are counted in sections of ``section_lines`` line numbers (by default a
        block of a file); one row for each of these is put in order.
        """
        closed, since = self._state(number)
        kind, place = F.get("_tokens", 0), F.struct("file", "line")
        marked = (
            computed_once(lines.select("file", "line", "value"), "_tokens", F.split(normalised(F.col("value")), " "))
            .filter(kind.isin(FRAME_OPEN, FRAME_CLOSE, *ALL_OPS))
            .withColumn("_close", (kind == FRAME_CLOSE).cast("long"))
            .withColumn("_section", F.floor(F.col("line") / self.section_lines))
        )
        earlier = Window.orderBy("file", "_section").rowsBetween(Window.unboundedPreceding, -1)
        sections = marked.groupBy("file", "_section").agg(F.sum("_close").alias("_n")).select(
            "file", "_section", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        within = Window.partitionBy("file", "_section").orderBy("line").rowsBetween(
            Window.unboundedPreceding, -1)
        numbered = (
            marked.withColumn("_here", F.coalesce(F.sum("_close").over(within), F.lit(0)))
            .join(sections, ["file", "_section"])
            .withColumn("frame", F.col("_before") + F.col("_here") + closed)
        )
        said = lambda i: F.coalesce(F.get("_tokens", i).try_cast("bigint"), F.lit(0))
        numbered = numbered.select(
            "frame", "file", "line", "value", kind.alias("kind"), said(1).alias("id"), said(2).alias("batch"))
        folder = f"{self.root}/lines/{number}"
        numbered.write.mode("overwrite").parquet(folder)
        stored = self.spark.read.schema(numbered.schema).parquet(folder)
        (
            stored.filter(F.col("kind") == FRAME_OPEN).groupBy("frame")
            .agg(F.max_by(F.struct("id", "batch"), place).alias("h"), F.max(place).alias("at"))
            .select("frame", "at", "h.id", "h.batch")
            .write.mode("overwrite").parquet(f"{self.root}/headers/{number}")
        )
        ends = stored.filter(F.col("kind") == FRAME_CLOSE).count()
        after = (closed + ends, number if ends else since)
        self.spark.createDataFrame([(number, *after)], _STATE).write.mode("overwrite").parquet(
            f"{self.root}/state/{number}")
        return self._closed(closed, closed + ends, since, number, numbered.schema)

    def _closed(self, first: int, end: int, since: int, number: int, schema) -> DataFrame:
        """The commands of the frames from ``first`` to before ``end``."""
        numbers = range(since, number + 1)
        done = (F.col("frame") >= first) & (F.col("frame") < end)
        headers = (
            self.spark.read.schema(_HEADER).parquet(*self._there("headers", numbers)).filter(done)
            .groupBy("frame").agg(F.max_by(F.struct("id", "batch"), "at").alias("h")))
        commands = (
            self.spark.read.schema(schema).parquet(*self._there("lines", numbers))
            .filter(done & F.col("kind").isin(*ALL_OPS)))
        # commands of a hot frame are split: the small side has a shuffle of its own
        headers = headers.withColumn("frame", F.col("frame").bitwiseOR(F.lit(0).cast("bigint")))
        return commands.join(headers, "frame", "left").select(
            "frame", F.coalesce("h.id", F.lit(0)).alias("frame_id"),
            F.coalesce("h.batch", F.lit(0)).alias("frame_batch"), "file", "line", "value")

    def _there(self, kind: str, numbers: range) -> list[str]:
        """The folders of those micro-batches that had lines."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = {s.getPath().getName() for s in fs.listStatus(path)}
        return [f"{self.root}/{kind}/{n}" for n in numbers if str(n) in names]


def run_frames(
    files: DataFrame,
    store: FrameStore,
    publish: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand on the frames that each micro-batch of :func:`sources.replay.numbered_files`
    closes."""

    def take(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # as many as the source's filesPerBatch
        if not paths:
            return
        lines = read_lines(batch.sparkSession, paths).select(
            file_number(F.col("file_name")).alias("file"), F.col("line_no").alias("line"), "value")
        publish(store.take(lines, number), number)

    return (
        files.writeStream.queryName("frames").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(take).start()
    )
