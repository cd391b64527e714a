"""The stored graph in buckets, its totals, what it forgets, and replay by number."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from replay import ROW, as_sets, in_batches, in_order, random_rows

from tidegraph.plans import file_queries, stream_queries
from tidegraph.sources import commands as lines_in
from tidegraph.sources import replay
from tidegraph.streaming import jobs
from tidegraph.streaming.frames import FrameStore, run_frames
from tidegraph.streaming.store import PARTS, GraphStore

ONCE = {"availableNow": True}
SOON = {"processingTime": "0 seconds"}
T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def same(store, expected):
    assert as_sets(store.graph()) == expected
    assert store.totals() == (len(expected[1]), len(expected[0]))


@pytest.mark.parametrize("seed,mode", [(31, "batch"), (32, "ordered")])
def test_totals_follow_batches_in_any_order(spark, tmp_path, seed, mode):
    rows = random_rows(seed, 100)
    store = GraphStore(spark, str(tmp_path / "marks"), mode, buckets=3)
    order, seen = list(range(10)), []
    random.Random(seed).shuffle(order)
    for i in range(5):  # two batches to a micro-batch
        mine = [r for r in rows if r[1] in order[2 * i : 2 * i + 2]]
        seen += mine
        store.append(frame(spark, mine), i)
        if i == 2:
            store.append(frame(spark, mine), i)  # again
            store.compact(i)
        same(store, in_batches(seen)[:2] if mode == "batch" else in_order(seen))
    store.prune(keep_bases=1)
    same(store, in_batches(rows)[:2] if mode == "batch" else in_order(rows))


def test_another_session_reads_the_buckets(spark, tmp_path):
    rows = random_rows(33, 60)
    store = GraphStore(spark, str(tmp_path / "marks"), buckets=3)
    store.append(frame(spark, [r for r in rows if r[1] < 3]), 0)
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("graph_marks_")]:
        spark.sql(f"drop table {name}")  # a session that did not write them knows no tables
    again = GraphStore(spark, str(tmp_path / "marks"))
    assert again.manifest().buckets == 3
    again.append(frame(spark, [r for r in rows if r[1] >= 3]), 1)
    same(again, in_batches(rows)[:2])


def test_reading_the_graph_moves_nothing(spark, tmp_path):
    rows = random_rows(34, 60)
    store = GraphStore(spark, str(tmp_path / "marks"), buckets=3)
    for i in range(3):
        store.append(frame(spark, [r for r in rows if r[1] // 2 == i]), i)
    graph = store.graph()
    for df in (graph.edges, graph.vertices):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    same(store, in_batches(rows)[:2])


def test_a_hub_is_spread_over_buckets(spark, tmp_path):
    n = 4000
    commands = spark.range(n).select(
        F.col("id").alias("seq"), F.lit(0).cast("long").alias("batch_id"), F.lit("addEdge").alias("op"),
        F.lit(7).cast("long").alias("src"), F.lit("a").alias("attr"), (F.col("id") + 10).alias("dst"))
    store = GraphStore(spark, str(tmp_path / "marks"), buckets=16)
    store.append(commands, 0)
    assert store.totals() == (n, n + 1)
    per_file = store._read("edge", store.manifest().deltas[0], 16).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) > PARTS // 2 and max(r["count"] for r in per_file) < n / 2
    gone = frame(spark, [(n, 1, "rmvNode", 7, None, None)])
    store.append(gone, 1)
    assert store.totals() == (0, n) and store.graph().edges.isEmpty()


def test_a_second_writer_is_refused(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "marks"), buckets=2)
    store.append(frame(spark, random_rows(35, 10)), 0)
    stale = store.manifest()
    store.append(frame(spark, random_rows(36, 10)), 1)
    with pytest.raises(Exception):  # noqa: B017 - a file system may raise its own
        store._commit(stale)
    assert store.deltas() == [0, 1]


def test_what_no_manifest_names_is_not_seen_and_goes(spark, tmp_path, monkeypatch):
    rows = random_rows(37, 40)
    store = GraphStore(spark, str(tmp_path / "marks"), buckets=2)
    store.append(frame(spark, [r for r in rows if r[1] < 2]), 0)

    def fail(manifest):
        raise RuntimeError("stopped before the commit")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fail)
        with pytest.raises(RuntimeError, match="before the commit"):
            store.append(frame(spark, [r for r in rows if r[1] == 2]), 1)
    same(store, in_batches([r for r in rows if r[1] < 2])[:2])
    left = len(os.listdir(tmp_path / "marks" / "tables"))
    store.append(frame(spark, [r for r in rows if r[1] >= 2]), 1)
    store.compact(1)
    store.prune(keep_bases=1)
    assert len(os.listdir(tmp_path / "marks" / "tables")) == 3 < left
    same(store, in_batches(rows)[:2])


def test_a_watermark_lets_the_store_forget(spark, tmp_path):
    """An edge an hour, each removed or expired after a while: only living edges and
    recent removals stay."""
    hours, ttl = 60, 10 * 3600
    rows = []
    for h in range(hours):
        at = T0 + dt.timedelta(hours=h)
        rows.append((h, at, "addEdge", h, "a", h + 1000))
        if h % 3 == 0 and h:
            rows.append((h, at, "rmvNode", h - 2, None, None))
        if h % 3 == 1:
            rows.append((h, at, "rmvEdge", h - 1, "a", h + 999))
    schema = "batch_id long, ts timestamp_ntz, op string, src long, attr string, dst long"
    for i in range(6):
        spark.createDataFrame([r for r in rows if r[0] // 10 == i], schema).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"{i}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    store = GraphStore(spark, str(tmp_path / "marks"), buckets=2)
    hour = lambda at: int((at.replace(tzinfo=None) - T0).total_seconds() // 3600)
    query = jobs.run_graph(
        stream, store, str(tmp_path / "progress"), ONCE, compact_every=1, lateness="2 hours",
        ttl_seconds=ttl, key_at=hour)
    query.awaitTermination()
    settled = store.manifest().settled
    # the watermark two hours behind, of the last but one micro-batch or earlier
    assert 20 <= settled <= hours - 10
    kept = store.marks("edge").collect()
    alive = {h for h in range(hours) if not any(
        (r[2] == "rmvEdge" and r[3] == h and r[0] > h) or (r[2] == "rmvNode" and r[3] in (h, h + 1000) and r[0] > h)
        for r in rows)}
    for r in kept:
        # nothing that ended or aged before the watermark
        assert max(r["last_add"] if r["last_add"] is not None else -1, r["last_rmv"] or -1) >= settled - 10
    assert {r["src"] for r in kept} >= {h for h in alive if h >= settled}
    removals = store.marks("vertex").filter("last_rmv is not null").collect()
    assert all(r["last_rmv"] >= settled for r in removals)
    now = F.lit(T0 + dt.timedelta(hours=hours - 1)).cast("timestamp_ntz")
    got = {r["src"] for r in store.graph(as_of=now, ttl_seconds=ttl).edges.collect()}
    assert got == {h for h in alive if h >= hours - 1 - 10}
    # a command from before is refused
    late = spark.createDataFrame([(settled - 1, T0, "addEdge", 1, "late", 2)], schema)
    before = store.totals()
    store.append(late, 99)
    assert store.totals() == before


def test_going_on_from_saved_graphs(spark, tmp_path):
    rows = random_rows(38, 60)
    parts = [[r for r in rows if r[1] == b] for b in range(6)]
    store = GraphStore(spark, str(tmp_path / "marks"), "ordered", buckets=2)
    assert store.graph_saved(5) is None
    assert store.append_steps([frame(spark, parts[0]), 70], 0) == [None]
    store.save(100)
    store.append_steps([frame(spark, parts[1])], 1)
    store.save(200)
    tables = len(os.listdir(tmp_path / "marks" / "tables"))
    for _ in range(2):  # again, as after a failure
        chosen = store.append_steps([frame(spark, parts[2]), 120, frame(spark, parts[3]), 150], 2)
        assert chosen == [100, 100]  # of two as near, the earlier
        same(store, in_order(parts[0]))
    assert len(os.listdir(tmp_path / "marks" / "tables")) == tables + 12  # two steps, twice: nothing is copied
    store.append_steps([frame(spark, parts[4])], 3)
    same(store, in_order(parts[0] + parts[4]))
    store.compact(max(store.deltas()))
    store.prune(keep_bases=1)
    same(store, in_order(parts[0] + parts[4]))
    assert as_sets(store.graph_saved(999)) == in_order(parts[0] + parts[1])
    store.append_steps([201, frame(spark, parts[5])], 4)
    same(store, in_order(parts[0] + parts[1] + parts[5]))


def write_numbered(folder, rows, batches):
    folder.mkdir(parents=True, exist_ok=True)
    for b in batches:
        text = "".join(" ".join(str(x) for x in r[2:] if x is not None) + "\n" for r in rows if r[1] == b)
        (folder / f"{b}.txt").write_text("\n" + text)


@pytest.mark.parametrize("ordered", [False, True])
def test_files_are_replayed_by_number(spark, tmp_path, ordered):
    rows = random_rows(41, 80)
    for b in (5, 3, 7, 1, 0, 2, 6, 4):  # written in another order
        write_numbered(tmp_path / "in", rows, [b])
        time.sleep(0.02)
    (tmp_path / "in" / "notes.txt").write_text("not a batch")
    files = replay.numbered_files(spark, str(tmp_path / "in"), filesPerBatch=3)
    store, seen = GraphStore(spark, str(tmp_path / "marks"), buckets=2), []
    jobs.until_caught_up(jobs.run_replay(
        files, store, str(tmp_path / "progress"), SOON, ordered=ordered,
        after_batch=lambda s, n: seen.append(as_sets(s.graph()))))
    fold = in_order if ordered else (lambda r: in_batches(r)[:2])
    assert seen == [fold([r for r in rows if r[1] < n]) for n in (3, 6, 8)]


def test_a_missing_number_is_waited_for_and_files_go_after_commit(spark, tmp_path):
    rows = random_rows(42, 60)
    write_numbered(tmp_path / "in", rows, [0, 1, 3])
    store = GraphStore(spark, str(tmp_path / "marks"), buckets=2)
    there = []

    def run(fail_at=None):
        def after(s, number):
            there.append(sorted(p.name for p in (tmp_path / "in").iterdir()))
            if number == fail_at:
                raise RuntimeError("stopped before the commit")

        files = replay.numbered_files(
            spark, str(tmp_path / "in"), dispose="archive", archiveDir=str(tmp_path / "used"))
        jobs.until_caught_up(jobs.run_replay(
            files, store, str(tmp_path / "progress"), SOON, after_batch=after))

    with pytest.raises(Exception, match="before the commit"):
        run(fail_at=1)
    # of the file whose micro-batch failed nothing is lost
    assert "1.txt" in there[-1] and "1.txt" in {p.name for p in (tmp_path / "in").iterdir()}
    run()
    same(store, in_batches([r for r in rows if r[1] < 2])[:2])
    write_numbered(tmp_path / "in", rows, [2, 4, 5])
    run()
    same(store, in_batches(rows)[:2])
    assert {"0.txt", "1.txt", "2.txt"} <= {p.name for p in (tmp_path / "used").iterdir()}


def test_counts_after_each_file_of_a_micro_batch(spark, tmp_path):
    """Files share micro-batches, edges live on from earlier ones, and one micro-batch
    fails after its compaction and runs again."""
    rows = random_rows(43, 270, ids=12, batch=20)
    last = max(r[1] for r in rows)
    write_numbered(tmp_path / "in", rows, range(last + 1))
    store, failed = GraphStore(spark, str(tmp_path / "marks"), buckets=2), []

    def after(s, number):
        if number == 3 and not failed:
            failed.append(number)
            raise RuntimeError("stopped before the commit")

    def run():
        files = replay.numbered_files(spark, str(tmp_path / "in"), filesPerBatch=3)
        jobs.until_caught_up(jobs.run_replay(
            files, store, str(tmp_path / "progress"), SOON, compact_every=2, after_batch=after,
            count_into=str(tmp_path / "series")))

    with pytest.raises(Exception, match="before the commit"):
        run()
    run()
    want = []
    for b in range(last + 1):
        vertices, edges = in_batches([r for r in rows if r[1] <= b])[:2]
        want.append((b, len(edges), len(vertices)))
    got = jobs.count_series_of(spark, str(tmp_path / "series")).orderBy("batch_id").collect()
    assert [tuple(r) for r in got] == want
    assert store.totals() == want[-1][1:]


@pytest.mark.parametrize("files", [0, 10, 36, 1000])
def test_a_replay_of_many_files_has_few_micro_batches(spark, tmp_path, files):
    for n in range(files):
        (tmp_path / f"{n}.txt").touch()
    taken = file_queries._files_a_batch(spark, str(tmp_path), 3)
    assert taken >= 3 and -(-files // taken) <= stream_queries.MICRO_BATCHES
    assert taken == 3 or files > 3 * stream_queries.MICRO_BATCHES


def plain_frames(lines):
    """Frame number, header and commands of the closed frames of all lines in turn."""
    out, header, held, n = [], (0, 0), [], 0
    for line in lines:
        words = line.split()
        if words[:1] == ["END_OF_FILE"]:
            out += [(n, *header, h) for h in held]
            header, held, n = (0, 0), [], n + 1
        elif words[:1] == ["FILE_INFO"]:
            header = (int(words[1]), int(words[2]))
        elif words and words[0] in ("addEdge", "rmvEdge", "addNode", "rmvNode"):
            held.append(" ".join(words))
    return sorted(out)


@pytest.mark.parametrize("per_batch", [1, 3])
def test_frames_go_on_over_files_and_micro_batches(spark, tmp_path, per_batch):
    rng = random.Random(per_batch)
    lines = []
    for _ in range(400):
        lines.append(rng.choices(
            [f"addNode {rng.randrange(50)}", f"FILE_INFO {rng.randrange(9)} {rng.randrange(9)}", "END_OF_FILE",
             "", "some other words", f"  addEdge  {rng.randrange(9)} a 3 "], [12, 2, 1, 1, 1, 5])[0])
    (tmp_path / "in").mkdir()
    cuts = sorted(rng.sample(range(400), 10))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 400])):
        (tmp_path / "in" / f"{i}").write_text("".join(x + "\n" for x in lines[a:b]))
    store, got = FrameStore(spark, str(tmp_path / "frames")), {}

    def publish(frames, number):
        got[number] = [
            (r["frame"], r["frame_id"], r["frame_batch"], " ".join(r["value"].split())) for r in frames.collect()]
        if number == 2 and got.get("failed") is None:
            got["failed"] = []
            raise RuntimeError("stopped before the commit")

    def run():
        files = replay.numbered_files(spark, str(tmp_path / "in"), filesPerBatch=per_batch)
        jobs.until_caught_up(run_frames(files, store, publish, str(tmp_path / "progress"), SOON))

    with pytest.raises(Exception, match="before the commit"):
        run()
    run()
    assert sorted(row for rows in got.values() for row in rows) == plain_frames(lines)


def test_malformed_commands_in_frames_stop_the_job(spark):
    lines = spark.createDataFrame(
        [("f", 0, "FILE_INFO 1 1"), ("f", 1, "addNode x"), ("f", 2, "END_OF_FILE")],
        "file string, line_no long, value string")
    with pytest.raises(Exception, match="bad number"):
        lines_in.read_frames_as_batches(lines).collect()
    assert lines_in.read_frames_as_batches(lines, mode="drop").collect() == []
