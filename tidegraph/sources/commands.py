"""Command lines: reading, parsing, framing and writing.

Lines stay lines of a splittable text source: no file is read as one value.
Where the order of lines matters, :func:`with_line_no` derives it from the
file block and the row's place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions.keys import own_shuffle
from tidegraph.functions.text import command_text, computed_once, normalised
from tidegraph.functions.times import parse_request_time
from tidegraph.model import ADD_EDGE, ADD_NODE, ALL_OPS, EDGE_OPS, RMV_EDGE, RMV_NODE
from tidegraph.session import ensure_checkpoint_dir

# The lines that frame a batch inside a longer file.
FRAME_OPEN = "FILE_INFO"
FRAME_CLOSE = "END_OF_FILE"

# Fixed value: the word that asks for a saved graph.
LOAD_OLD = "loadOld"

# The order in which the four command sets are written out.
WRITE_ORDER = (ADD_EDGE, ADD_NODE, RMV_EDGE, RMV_NODE)

_ROW_BITS = 33  # rows per partition in monotonically_increasing_id
_MIN_SPLIT = 1 << 16


# --- parsing -----------------------------------------------------------------


def parse_commands(lines: DataFrame, mode: str = "fail", value_col: str = "value") -> DataFrame:
    """Add ``op, src, attr, dst`` to rows of text; works on streams as well.

    Blank lines and unknown first words are ignored. A known command that is
    too short or has a number that is none stops the job (``fail``), is dropped
    (``drop``), or is kept with the reason in ``_error`` (``quarantine``, which
    keeps unknown commands too). Tokens beyond those needed are ignored.
    """
    if mode not in ("drop", "fail", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    token = lambda i: F.get("_tokens", i)
    is_edge = token(0).isin(*EDGE_OPS)
    problem = (
        F.when(~token(0).isin(*ALL_OPS), "unknown command")
        .when(F.size("_tokens") < F.when(is_edge, 4).otherwise(2), "too short")
        .when(
            token(1).try_cast("bigint").isNull()
            | (is_edge & token(3).try_cast("bigint").isNull()),
            "bad number",
        )
    )
    rows = (
        computed_once(lines, "_tokens", F.split(normalised(F.col(value_col)), " "))
        .filter(token(0) != "")
        .withColumn("_error", problem)
        .withColumn("op", token(0))
        .withColumn("src", token(1).try_cast("bigint"))
        .withColumn("attr", F.when(is_edge, token(2)))
        .withColumn("dst", F.when(is_edge, token(3).try_cast("bigint")))
        .drop("_tokens")
    )
    if mode == "quarantine":
        return rows
    known = rows.filter(F.col("_error").isNull() | (F.col("_error") != "unknown command"))
    if mode == "drop":
        return known.filter(F.col("_error").isNull()).drop("_error")
    stop = F.raise_error(F.concat_ws(": ", F.col("_error"), F.col(value_col)))
    return known.withColumn(
        "op", F.when(F.col("_error").isNull(), F.col("op")).otherwise(stop.cast("string"))
    ).drop("_error")


def parse_load_requests(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``at_millis`` to the ``loadOld yyyy-MM-dd HH:mm:ss`` lines among
    others; null where the time is malformed."""
    trimmed = computed_once(lines, "_line", normalised(F.col(value_col)))
    asked = F.substr("_line", F.lit(len(LOAD_OLD) + 2))
    return (
        trimmed.filter(F.startswith("_line", F.lit(LOAD_OLD + " ")))
        .withColumn("at_millis", parse_request_time(asked))
        .drop("_line")
    )


def normalise_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Trimmed lines without the blank ones."""
    others = [c for c in lines.columns if c != value_col]
    trimmed = computed_once(lines, "_line", normalised(F.col(value_col)))
    return trimmed.filter(F.col("_line") != "").select(
        *others, F.col("_line").alias(value_col)
    )


def format_commands(commands: DataFrame) -> DataFrame:
    """Add ``value``, the text line of each command."""
    return commands.withColumn("value", command_text())


def only(commands: DataFrame, *ops: str) -> DataFrame:
    """The commands of the given kinds; the filter reaches the scan."""
    return commands.filter(F.col("op").isin(*ops))


# --- reading files -----------------------------------------------------------


def _text_rows(reader, path) -> DataFrame:
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def file_number(file_name: Column) -> Column:
    """The number a batch file is named after (``7`` or ``7.txt``), else null."""
    return F.regexp_extract(file_name, r"^(\d+)(?:\.[A-Za-z]+)?$", 1).try_cast("bigint")


def _bytes_setting(spark: SparkSession, key: str) -> int:
    utils = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    return utils.byteStringAsBytes(spark.conf.get(key))


def with_line_no(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, which grows along the lines of each file.

    Call it directly on rows of :func:`read_lines` or of a micro-batch read by
    :func:`stream_lines`, before anything shuffles them. A block of a file is
    read in order by one task, so the block's place in the file and the row's
    place in the task order the lines with neither a second pass nor a
    shuffle. Numbers are unique and increasing within a file, not consecutive.
    """
    spark = lines.sparkSession
    # No block but a file's last is shorter than the smaller of the two.
    block = min(
        _bytes_setting(spark, "spark.sql.files.maxPartitionBytes"),
        _bytes_setting(spark, "spark.sql.files.openCostInBytes"),
    )
    if block < _MIN_SPLIT:
        raise ValueError("file splits below 64 KiB leave no room for line numbers")
    block_no = F.floor(F.col("block_start") / block).cast("long")
    row_no = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return lines.withColumn("line_no", F.shiftleft(block_no, _ROW_BITS) + row_no)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, file, file_name, block_start, line_no)`` of text files."""
    return with_line_no(_text_rows(spark.read, path))


def _numbered(lines: DataFrame, skip_others: bool) -> DataFrame:
    """Lines with the number of their file as ``batch_id``."""
    numbered = lines.withColumn("batch_id", file_number(F.col("file_name")))
    if skip_others:
        return numbered.filter(F.col("batch_id").isNotNull())
    stop = F.raise_error(F.concat(F.lit("file without a number: "), F.col("file"))).cast("bigint")
    return numbered.withColumn("batch_id", F.coalesce("batch_id", stop))


def read_numbered_batches(
    spark: SparkSession, path: str | list[str], mode: str = "fail", skip_others: bool = False
) -> DataFrame:
    """Commands of files named ``0, 1, 2 …``; the file number is the batch.

    ``seq`` orders the commands of one batch. Batches are ordered by number,
    so ``10`` follows ``9``. A file without a number stops the job, or is left
    out with ``skip_others``.
    """
    lines = _numbered(read_lines(spark, path), skip_others).withColumnRenamed("line_no", "seq")
    return parse_commands(lines, mode).select(
        "seq", "batch_id", "file", "op", "src", "attr", "dst"
    )


# --- frames inside files -----------------------------------------------------


def rank_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows 1, 2, 3 … in a total order, without one task seeing all.

    The rows are range-sorted over all tasks and checkpointed, so that the
    places they landed in are fixed; each task's rows then continue after the
    count of the tasks before it. The table of counts has one row per task.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    placed = (
        rows.orderBy(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_task", F.shiftright("_place", _ROW_BITS))
    )
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_task")
        .agg(F.count("*").alias("_n"))
        .select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    row_no = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), "_task").select(
        *rows.columns, (F.col("_before") + row_no + 1).alias(name)
    )


def frame_lines(
    lines: DataFrame,
    file_col: str = "file",
    line_col: str = "line_no",
    section_lines: int = 1 << _ROW_BITS,
) -> DataFrame:
    """Commands of framed files with ``frame``, ``frame_id`` and ``frame_batch``.

    A frame is what stands before an ``END_OF_FILE`` line and after the one
    before it; its ``FILE_INFO id batch`` line (the last, if several; 0 and 0
    if none) gives the numbers. What follows the last ``END_OF_FILE`` is
    dropped, and so are lines that hold no command.

    Files are cut into sections of ``section_lines`` line numbers (by default
    a file block), so that a file of any length is counted by many tasks.
    """
    number = lambda i: F.coalesce(F.get("_tokens", i).try_cast("bigint"), F.lit(0))
    kind = F.get("_tokens", 0)
    marked = (
        computed_once(lines, "_tokens", F.split(normalised(F.col("value")), " "))
        .filter(kind.isin(FRAME_OPEN, FRAME_CLOSE, *ALL_OPS))
        .withColumn("_close", (kind == FRAME_CLOSE).cast("long"))
        .withColumn("_section", F.floor(F.col(line_col) / section_lines))
    )
    earlier = (
        Window.partitionBy(file_col)
        .orderBy("_section")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sections = (
        marked.groupBy(file_col, "_section")
        .agg(F.sum("_close").alias("_n"))
        .select(
            file_col,
            "_section",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(file_col)).alias("_frames"),
        )
    )
    within = (
        Window.partitionBy(file_col, "_section")
        .orderBy(line_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    framed = (
        marked.withColumn("_in_section", F.coalesce(F.sum("_close").over(within), F.lit(0)))
        .join(sections, [file_col, "_section"])
        .withColumn("frame", F.col("_before") + F.col("_in_section"))
        .filter(F.col("frame") < F.col("_frames"))
    )
    header = F.when(kind == FRAME_OPEN, F.struct(number(1).alias("id"), number(2).alias("batch")))
    headers = (
        framed.filter(kind == FRAME_OPEN)
        .groupBy(file_col, "frame")
        .agg(F.max_by(header, line_col).alias("_header"))
        .withColumn("frame", own_shuffle("frame"))
    )
    return (
        framed.filter(kind.isin(*ALL_OPS))
        .join(headers, [file_col, "frame"], "left")
        .select(
            "value",
            file_col,
            line_col,
            "frame",
            F.coalesce("_header.id", F.lit(0)).alias("frame_id"),
            F.coalesce("_header.batch", F.lit(0)).alias("frame_batch"),
        )
    )


def read_frames_as_batches(
    lines: DataFrame,
    file_col: str = "file",
    line_col: str = "line_no",
    section_lines: int = 1 << _ROW_BITS,
    mode: str = "fail",
) -> DataFrame:
    """Commands of framed files; each frame that holds a command is a batch.

    ``batch_id`` counts the frames from 1 by batch number, id, file and place.
    """
    commands = parse_commands(frame_lines(lines, file_col, line_col, section_lines), mode)
    place = ["frame_batch", "frame_id", file_col, "frame"]
    frames = rank_rows(commands.select(*place).distinct(), place, "batch_id")
    return commands.join(frames, place).select(
        F.col(line_col).alias("seq"),
        "batch_id",
        "frame_batch",
        "frame_id",
        file_col,
        "frame",
        "op",
        "src",
        "attr",
        "dst",
    )


# --- streams -----------------------------------------------------------------


def stream_lines(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    clean_source: str | None = None,
    archive_dir: str | None = None,
) -> DataFrame:
    """New text files of a folder as a stream of lines.

    ``max_files`` throttles a replay of stored files. ``clean_source``
    (``archive`` or ``delete``) disposes of files once their micro-batch is
    committed, so a restart never loses input.
    """
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if clean_source is not None:
        reader = reader.option("cleanSource", clean_source)
        if clean_source == "archive":
            reader = reader.option("sourceArchiveDir", archive_dir)
    return _text_rows(reader, path)


def stream_numbered_batches(
    spark: SparkSession, path: str, mode: str = "fail", skip_others: bool = False, **options
) -> DataFrame:
    """Commands of numbered files as a stream; the file number is the batch.

    Keeps ``file`` and ``block_start`` so that :func:`with_line_no` can order
    the commands of a micro-batch.
    """
    lines = _numbered(stream_lines(spark, path, **options), skip_others)
    return parse_commands(lines, mode).select(
        "batch_id", "file", "block_start", "op", "src", "attr", "dst"
    )


def stream_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a text socket as a stream, with their arrival time."""
    return (
        spark.readStream.format("socket")
        .option("host", host)
        .option("port", port)
        .option("includeTimestamp", True)
        .load()
        .withColumnRenamed("timestamp", "ts")
    )


# --- writing -----------------------------------------------------------------


def write_batches(commands: DataFrame, path: str) -> None:
    """Deduplicated commands as parquet, one folder per ``batch_id``.

    Only the folders of the batches at hand are replaced, so writing a batch
    again leaves one copy of it. A batch goes to one writer, and so to one file,
    unless it is large: rebalancing splits a batch that holds most of the data.
    """
    from tidegraph.operators.reduction import COMMAND_KEY, dedup_commands

    (
        dedup_commands(commands)
        .select("batch_id", *COMMAND_KEY)
        .hint("rebalance", "batch_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Commands written by :func:`write_batches`."""
    return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))


def write_command_text(commands: DataFrame, path: str) -> None:
    """Commands as text, the four kinds in a fixed order."""
    rank = F.array_position(F.array(*[F.lit(op) for op in WRITE_ORDER]), F.col("op"))
    (
        commands.orderBy(rank, "src", "attr", "dst")
        .select(command_text().alias("value"))
        .write.mode("overwrite")
        .text(path)
    )
