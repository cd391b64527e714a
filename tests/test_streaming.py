"""Streams must leave what the batch form gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from replay import ROW, as_sets, in_batches, in_order, random_rows

from tidegraph.operators import expiry, generate
from tidegraph.plans import stream_queries
from tidegraph.sources import commands as lines_in
from tidegraph.sources import snapshots
from tidegraph.streaming import jobs
from tidegraph.streaming.store import GraphStore

ONCE = {"availableNow": True}
T0 = dt.datetime(2024, 1, 1)


def line(row):
    return " ".join(str(x) for x in row[2:] if x is not None) + "\n"


def write_batches(folder, rows, batches):
    folder.mkdir(parents=True, exist_ok=True)
    for b in batches:
        (folder / f"{b}.txt").write_text("\n" + "".join(line(r) for r in rows if r[1] == b))


def stream(spark, folder, **options):
    return lines_in.stream_numbered_batches(spark, str(folder), **options)


@pytest.mark.parametrize("ordered", [False, True])
def test_files_arriving_in_any_order(spark, tmp_path, ordered):
    rows = random_rows(21, 80)
    store = GraphStore(spark, str(tmp_path / "marks"))
    for batches in ([5, 1, 7], [0, 6, 3], [], [2, 4]):
        write_batches(tmp_path / "in", rows, batches)
        jobs.run_graph(
            stream(spark, tmp_path / "in", max_files=2),
            store,
            str(tmp_path / "progress"),
            ONCE,
            reduce_first=ordered,
            compact_every=3,
        ).awaitTermination()
    expected = in_order(rows) if ordered else in_batches(rows)[:2]
    assert as_sets(store.graph()) == expected


def test_a_saved_stream_can_be_loaded_again(spark, tmp_path):
    rows, root = random_rows(25, 40), str(tmp_path / "saved")
    write_batches(tmp_path / "in", rows, range(4))
    store = GraphStore(spark, str(tmp_path / "marks"))
    jobs.run_graph(
        stream(spark, tmp_path / "in"),
        store,
        str(tmp_path / "progress"),
        ONCE,
        after_batch=jobs.save_each_batch(root),
    ).awaitTermination()
    now = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1000)
    assert as_sets(snapshots.load_old(spark, root, now)) == in_batches(rows)[:2]


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_repeated_micro_batches_and_compaction(spark, tmp_path):
    rows = random_rows(22, 60)
    store = GraphStore(spark, str(tmp_path / "marks"))
    assert as_sets(store.graph()) == (set(), set())
    seen = []
    for number in range(6):
        mine = [r for r in rows if r[1] == number]
        seen += mine
        for _ in range(2):
            store.append(frame(spark, mine), number)
        if number in (2, 4):
            store.compact(number, settled=number + 1)
        if number == 4:
            assert store.prune() == [0, 1, 2, 3, 4]
        assert as_sets(store.graph()) == in_batches(seen)[:2], number
    assert as_sets(store.graph(upto=2)) == in_batches([r for r in rows if r[1] <= 2])[:2]
    assert store.deltas() == [5]


def test_socket_like_input_is_stored(spark, tmp_path):
    """Lines with an arrival time, as a socket gives them: ticks are batches."""
    data = [(T0, "addEdge 1 a 2"), (T0 + dt.timedelta(seconds=6), "rmvNode 2"), (T0, "hello")]
    lines = spark.createDataFrame(data, "ts timestamp, value string")
    commands = jobs.with_tick_batches(lines_in.parse_commands(lines))
    store = GraphStore(spark, str(tmp_path / "marks"))
    store.append(commands, 0)
    assert as_sets(store.graph()) == ({1}, set())
    assert store.marks("edge").first()["last_add_ts"] == T0


@pytest.mark.parametrize("seed", range(3))
def test_settling_forgets_only_what_cannot_matter(spark, tmp_path, seed):
    """After settling at a key, any later commands give the same graph."""
    rows = random_rows(seed + 500, 80)
    store = GraphStore(spark, str(tmp_path / "marks"))
    store.append(frame(spark, [r for r in rows if r[1] < 4]), 0)
    kept = store.marks("edge").count() + store.marks("vertex").count()
    store.compact(0, settled=4)
    assert store.marks("edge").count() + store.marks("vertex").count() < kept
    store.append(frame(spark, [r for r in rows if r[1] >= 4]), 1)
    assert as_sets(store.graph()) == in_batches(rows)[:2]


def test_empty_micro_batches_are_skipped(spark, tmp_path):
    write_batches(tmp_path / "in", [], [0, 1])
    store = GraphStore(spark, str(tmp_path / "marks"))
    calls = []
    jobs.run_graph(
        stream(spark, tmp_path / "in"),
        store,
        str(tmp_path / "progress"),
        ONCE,
        after_batch=lambda s, n: calls.append(n),
    ).awaitTermination()
    assert calls == [] and store.deltas() == []


def test_used_input_is_archived(spark, tmp_path):
    rows = random_rows(23, 30)
    store = GraphStore(spark, str(tmp_path / "marks"))
    for b in range(3):
        write_batches(tmp_path / "in", rows, [b])
        jobs.run_graph(
            stream(
                spark,
                tmp_path / "in",
                clean_source="archive",
                archive_dir=str(tmp_path / "used"),
            ),
            store,
            str(tmp_path / "progress"),
            ONCE,
        ).awaitTermination()
    assert as_sets(store.graph()) == in_batches(rows)[:2]
    assert len(list((tmp_path / "used").rglob("*.txt"))) >= 1


def test_streamed_expiry_equals_batch(spark, tmp_path):
    schema = "ts timestamp_ntz, op string, src bigint, attr string, dst bigint"
    seconds = {"a": [0, 4, 14, 30], "b": [3], "c": [40], "end": [60]}
    rows = [
        (T0 + dt.timedelta(seconds=s), "addEdge", 1, label, 2)
        for label, times in seconds.items()
        for s in times
    ]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.run_expiry(
        source, 10, "0 seconds", str(tmp_path / "out"), str(tmp_path / "progress"), ONCE
    ).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    until = F.lit(T0 + dt.timedelta(seconds=60)).cast("timestamp_ntz")
    expected = expiry.expiry_commands(df, 10, until)
    pairs = lambda d: sorted((r["attr"], r["ts"]) for r in d.collect())
    assert pairs(found) == pairs(expected)
    assert [(a, (t - T0).total_seconds()) for a, t in pairs(found)] == [
        ("a", 24), ("a", 40), ("b", 13), ("c", 50),
    ]


def test_running_word_counts_publish_changes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    published = []

    def run():
        jobs.run_word_counts(
            spark.readStream.text(str(folder)),
            lambda m, n: published.append({r["message"] for r in m.collect()}),
            str(tmp_path / "progress"),
            text_col="value",
            trigger=ONCE,
        ).awaitTermination()

    (folder / "a").write_text("red  blue\nred\n")
    run()
    (folder / "b").write_text("blue green")
    run()
    assert [p for p in published if p] == [{"red|2", "blue|1"}, {"blue|2", "green|1"}]


def test_raw_lines_keep_copies(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("addNode 1\naddNode 1\n")
    jobs.run_raw_sink(
        lines_in.stream_lines(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "p"), ONCE
    ).awaitTermination()
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["addNode 1"] * 2


def test_metrics_per_micro_batch(spark, tmp_path):
    rows = random_rows(24, 40)
    write_batches(tmp_path / "in", rows, range(4))
    listener = jobs.BatchMetrics()
    spark.streams.addListener(listener)
    try:
        query = jobs.run_graph(
            jobs.observed(stream(spark, tmp_path / "in", max_files=1)),
            GraphStore(spark, str(tmp_path / "marks")),
            str(tmp_path / "progress"),
            ONCE,
        )
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        import time

        deadline = time.time() + 20
        while len(listener.records) < 4 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r["n_commands"] for r in listener.records) >= 40
    assert {r["last_batch"] for r in listener.records} == {0, 1, 2, 3}
    assert all(r["build_ms"] > 0 for r in listener.records)


def test_ticks_number_five_second_batches(spark):
    data = [(T0 + dt.timedelta(seconds=s),) for s in (0, 4, 5, 9, 10)]
    df = jobs.with_tick_batches(spark.createDataFrame(data, "ts timestamp_ntz"))
    numbers = [r["batch_id"] for r in df.orderBy("ts").collect()]
    assert [n - numbers[0] for n in numbers] == [0, 0, 1, 1, 2]


def test_generated_stream(spark, tmp_path):
    source = generate.generate_stream(spark, 200, generate.CHURN, seed=5)
    query = (
        source.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "p"))
        .trigger(processingTime="1 second")
        .start(str(tmp_path / "out"))
    )
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if query.lastProgress and query.lastProgress["batchId"] >= 3:
                break
    finally:
        query.stop()
    found = spark.read.parquet(str(tmp_path / "out"))
    n = found.count()
    assert n > 0
    assert found.exceptAll(generate.generate(spark, n, generate.CHURN, seed=5)).isEmpty()


@pytest.mark.parametrize("in_files", [1, 3])
def test_a_table_is_one_file_or_a_folder_of_files(spark, tmp_path, in_files):
    rows = [(i, text) for i, text in enumerate(["to be or", "not to be", None, "be"])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    table.repartition(in_files).write.parquet(str(tmp_path / "documents.parquet"))
    if in_files == 1:
        (part,) = (tmp_path / "documents.parquet").glob("part-*.parquet")
        (tmp_path / "one").mkdir()
        part.rename(tmp_path / "one" / "documents.parquet")
    sf_dir = str(tmp_path / "one" if in_files == 1 else tmp_path)
    said = stream_queries.streamed_word_counts(spark, sf_dir).collect()
    assert sorted(r["message"] for r in said) == ["be|3", "not|1", "or|1", "to|2"]
