"""Reading, parsing, framing and writing commands; saved graphs; messages."""

import json

import pytest
from pyspark.sql import functions as F
from replay import as_sets

from tidegraph.model import Graph
from tidegraph.operators import compare, generate, marks, tweets
from tidegraph.operators import graph as ops
from tidegraph.sources import commands as lines_in
from tidegraph.sources import snapshots
from tidegraph.sources import tweets as tweets_in


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def text_of(df):
    return sorted(r["value"] for r in lines_in.format_commands(df).collect())


def write(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(r + "\n" for r in rows))


# --- parsing -----------------------------------------------------------------


def test_good_lines_survive_a_round_trip(spark):
    good = ["addEdge 1 knows 2", "rmvEdge -1 a,b 2", "addNode 7", "rmvNode 7"]
    padded = lines(spark, *[f"  {g} \r\n" for g in good], "", " \t")
    assert text_of(lines_in.parse_commands(padded)) == sorted(good)


def test_trailing_line_end_does_not_hide_a_removal(spark):
    rows = lines(spark, "addEdge 1 a 2\n", "rmvEdge 1 a 2\n", "addNode 3\n", "rmvNode 3\n")
    commands = lines_in.parse_commands(rows).select(
        F.monotonically_increasing_id().alias("seq"), "op", "src", "attr", "dst"
    )
    assert as_sets(marks.build_graph(commands, "ordered")) == ({1, 2}, set())


BAD = ["addEdge 1 a", "addEdge x a 2", "addEdge 1 a y", "rmvNode", "addNode 1.5"]


def test_malformed_lines_are_dropped_or_set_aside(spark):
    mixed = lines(spark, "addNode 1", "hello 2", *BAD)
    assert text_of(lines_in.parse_commands(mixed, "drop")) == ["addNode 1"]
    kept = lines_in.parse_commands(mixed, mode="quarantine")
    assert {r["value"]: r["_error"] for r in kept.collect()} == {
        "addNode 1": None,
        "hello 2": "unknown command",
        "addEdge 1 a": "too short",
        "addEdge x a 2": "bad number",
        "addEdge 1 a y": "bad number",
        "rmvNode": "too short",
        "addNode 1.5": "bad number",
    }


@pytest.mark.parametrize("bad", BAD)
def test_malformed_lines_can_stop_the_job(spark, bad):
    with pytest.raises(Exception, match="too short|bad number"):
        lines_in.parse_commands(lines(spark, bad), mode="fail").collect()


def test_unknown_commands_never_stop_the_job(spark):
    assert lines_in.parse_commands(lines(spark, "hello 2"), mode="fail").count() == 0


# --- files -------------------------------------------------------------------


def test_batches_are_numbered_not_spelt(spark, tmp_path):
    folder = tmp_path / "in"
    for n in (2, 10, 9):
        write(folder, f"{n}", f"addNode {n}")
    write(folder, "11.txt", "addNode 11")
    write(folder, "notes", "addNode 99")
    with pytest.raises(Exception, match="without a number"):
        lines_in.read_numbered_batches(spark, str(folder)).collect()
    rows = lines_in.read_numbered_batches(spark, str(folder), skip_others=True).collect()
    assert {(r["batch_id"], r["src"]) for r in rows} == {(2, 2), (9, 9), (10, 10), (11, 11)}


def test_line_numbers_follow_the_file_across_blocks(spark, tmp_path):
    folder = tmp_path / "in"
    n = 60_000
    write(folder, "0", *[f"addNode {i}" for i in range(n)])
    write(folder, "1", *[f"addNode {i}" for i in range(0, 1000)])
    keys = {"spark.sql.files.maxPartitionBytes": "128KB", "spark.sql.files.openCostInBytes": "64KB"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = lines_in.read_numbered_batches(spark, str(folder))
        assert rows.rdd.getNumPartitions() > 3
        got = rows.filter("batch_id = 0").orderBy("seq").select("src").collect()
        assert [r[0] for r in got] == list(range(n))
        assert rows.select("batch_id", "seq").distinct().count() == n + 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_writing_a_batch_again_keeps_one_copy(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, b, "addNode", i % 3, None, None) for b in (1, 2) for i in range(6)]
    schema = "seq bigint, batch_id bigint, op string, src bigint, attr string, dst bigint"
    df = spark.createDataFrame(rows, schema)
    lines_in.write_batches(df, path)
    lines_in.write_batches(df.filter("batch_id = 2"), path)
    back = lines_in.read_batches(spark, path)
    assert sorted((r["batch_id"], r["src"]) for r in back.collect()) == [
        (b, i) for b in (1, 2) for i in range(3)
    ]


def test_files_of_stored_batches_grow_with_batches(spark, tmp_path):
    path = tmp_path / "out"
    df = spark.range(4000).selectExpr(
        "id as seq", "id div 100 as batch_id", "'addEdge' as op", "id as src", "'a' as attr", "id as dst")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        lines_in.write_batches(df, str(path))
        # several tasks write, a batch's rows go to one of them
        assert len(list(path.glob("batch_id=*"))) == len(list(path.glob("batch_id=*/part-*"))) == 40
        # a batch that is most of the data is split
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
        lines_in.write_batches(df.withColumn("batch_id", F.expr("if(seq < 3900, 0, batch_id)")), str(path))
        assert len(list(path.glob("batch_id=0/part-*"))) > 1
        assert lines_in.read_batches(spark, str(path)).filter("batch_id = 0").count() == 3900
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_command_text_lists_kinds_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lines_in.parse_commands(
        lines(spark, "rmvNode 1", "rmvEdge 1 a 2", "addNode 1", "addEdge 1 a 2")
    )
    lines_in.write_command_text(rows, path)
    ordered = [r["value"] for r in lines_in.read_lines(spark, path).orderBy("file", "line_no").collect()]
    assert ordered == ["addEdge 1 a 2", "addNode 1", "rmvEdge 1 a 2", "rmvNode 1"]


# --- frames ------------------------------------------------------------------


def framed(spark, *values, section_lines=3):
    rows = [("f", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, value string")
    found = lines_in.read_frames_as_batches(df, section_lines=section_lines)
    return {
        (r["batch_id"], r["frame_batch"], r["frame_id"], r["op"], r["src"])
        for r in found.collect()
    }


def test_frames_are_ordered_by_batch_then_id(spark):
    assert framed(
        spark,
        "FILE_INFO 2 1", "addNode 1", "END_OF_FILE",
        "FILE_INFO 1 1", "addNode 2", "addNode 3", "END_OF_FILE",
        "FILE_INFO 9 0", "addNode 4", "END_OF_FILE",
    ) == {
        (1, 0, 9, "addNode", 4),
        (2, 1, 1, "addNode", 2),
        (2, 1, 1, "addNode", 3),
        (3, 1, 2, "addNode", 1),
    }


def test_equal_headers_keep_their_place(spark):
    assert framed(
        spark, "FILE_INFO 1 1", "addNode 1", "END_OF_FILE", "FILE_INFO 1 1", "addNode 2", "END_OF_FILE"
    ) == {(1, 1, 1, "addNode", 1), (2, 1, 1, "addNode", 2)}


def test_empty_headless_and_open_frames(spark):
    assert framed(
        spark,
        "FILE_INFO 1 1", "addNode 1", "END_OF_FILE",
        "END_OF_FILE",
        "FILE_INFO 3 3", "hello", "END_OF_FILE",
        "addNode 2", "END_OF_FILE",
        "FILE_INFO 5 5", "addNode 3",
    ) == {(1, 0, 0, "addNode", 2), (2, 1, 1, "addNode", 1)}


# --- saved graphs ------------------------------------------------------------


def small_graph(spark):
    edges = [(1, 2, "a"), (2, 1, "b,c) d"), (-3, -3, "x")]
    return Graph(
        spark.createDataFrame([(1, 1), (2, 1), (-3, 1), (9, 1)], "id bigint, attr bigint"),
        spark.createDataFrame(edges, "src bigint, dst bigint, attr string"),
    )


def test_labels_with_commas_and_brackets_are_read_back_whole(spark, tmp_path):
    root, g = str(tmp_path), small_graph(spark)
    snapshots.write_snapshot_text(g, root, 1000)
    assert as_sets(snapshots.read_snapshot_text(spark, root, 1000)) == as_sets(g)


def test_loading_the_nearest_saved_graph(spark, tmp_path):
    g, none = small_graph(spark), Graph(*[d.limit(0) for d in (small_graph(spark).vertices, small_graph(spark).edges)])
    assert snapshots.load_old(spark, str(tmp_path / "nothing"), 5) is None
    root = str(tmp_path / "parquet")
    snapshots.write_snapshot(none, root, 1000)
    snapshots.write_snapshot(none, root, 2000)
    snapshots.write_snapshot(g, root, 2000)
    assert as_sets(snapshots.load_old(spark, root, 1500)) == (set(), set())
    assert as_sets(snapshots.load_old(spark, root, 1501)) == as_sets(g)
    root = str(tmp_path / "text")
    snapshots.write_snapshot_text(none, root, "notes")
    snapshots.write_snapshot_text(g, root, 7000)
    assert as_sets(snapshots.load_old(spark, root, 1, text=True)) == as_sets(g)


# --- graphs ------------------------------------------------------------------


def test_missing_endpoints_get_the_default(spark):
    v = spark.createDataFrame([(1, 5), (1, 5), (4, 6)], "id bigint, attr bigint")
    e = spark.createDataFrame([(1, 2, "a")], "src bigint, dst bigint, attr string")
    built = ops.make_graph(v, e, default_attr=0)
    assert {tuple(r) for r in built.vertices.collect()} == {(1, 5), (2, 0), (4, 6)}


def test_merged_labels_are_a_view(spark):
    e = spark.createDataFrame(
        [(1, 2, "b"), (1, 2, "a"), (1, 2, "b"), (2, 1, "a")], "src bigint, dst bigint, attr string"
    )
    merged = ops.merge_parallel_edges(e)
    assert {tuple(r) for r in merged.collect()} == {(1, 2, "a b"), (2, 1, "a")}
    left = ops.remove_edges(e, e.filter("src = 1 and attr = 'a'"))
    assert {tuple(r) for r in left.collect()} == {(1, 2, "b"), (2, 1, "a")}


def test_comparisons_tell_sets_from_bags(spark):
    g = small_graph(spark)
    twice = Graph(g.vertices, g.edges.unionAll(g.edges))
    assert compare.graphs_equal(g, twice).first()["equal"]
    assert not compare.graphs_equal_by_counts(g, twice).first()["equal"]
    assert compare.graphs_equal_by_counts(g, g).first()["equal"]
    assert compare.graph_contained(g, twice).first()["contained"]
    assert not compare.graph_contained(twice, g).first()["contained"]
    less = Graph(g.vertices, g.edges.filter("src <> 1"))
    assert compare.graph_contained(less, g).first()["contained"]
    assert not compare.graph_contained(g, less).first()["contained"]
    report = compare.graphs_equal(g, less).first()
    assert (report["equal"], report["edge_only_left"], report["edge_only_right"]) == (False, 1, 0)
    assert [r["change"] for r in compare.edge_diff(g, less).collect()] == ["removed"]
    copies = spark.createDataFrame([(1,), (1,), (2,), (3,)], "x int")
    rest = compare.bag_difference(copies, copies.filter("x = 2"))
    assert sorted(r["x"] for r in rest.collect()) == [1, 1, 3]


def test_registered_views(spark):
    small_graph(spark).register("small_")
    n = spark.sql("select count(*) from small_triplets t join small_vertices v on v.id = t.src").first()[0]
    assert n == 3


# --- messages ----------------------------------------------------------------


def test_messages_with_missing_parts(spark, tmp_path):
    rows = [
        {"id": 1, "user": {"id": 5, "followers_count": 2}, "text": "a b\nc\r", "contributors": [6], "user_mentions": [{"id": 7}, {"id": 7}]},
        {"id": 2, "user": {"id": 5, "followers_count": 2}, "text": "x", "contributors": None},
    ]
    write(tmp_path / "in", "t.json", *[json.dumps(r) for r in rows])
    read = tweets_in.read_tweets(spark, str(tmp_path / "in"))
    users = {r["id"]: r["users"] for r in tweets.involved_users(read).collect()}
    assert users == {1: [5, 6, 7, 7], 2: [5]}
    assert sorted(r["value"] for r in tweets.mention_lines(read).collect()) == [
        "addEdge 5 a_bc 6",
        "addEdge 5 a_bc 7",
        "addEdge 5 a_bc 7",
    ]


def test_follower_pages_and_made_up_followers(spark):
    pages = spark.createDataFrame(
        [(5, '{"ids":[1,"x",2],"next_cursor":0}'), (6, '{"errors":[]}')], "user_id bigint, value string"
    ).select("user_id", tweets_in.page_ids(F.col("value")).alias("ids"))
    users = spark.createDataFrame([(5, 9), (6, 3), (7, 0), (8, 4), (8, 4)], "user_id bigint, n_followers int")
    found = tweets.with_follower_ids(users, pages).collect()
    by_user = {}
    for r in found:
        by_user.setdefault(r["user_id"], []).append(r["follower_id"])
    assert sorted(by_user[5]) == [1, 2]
    assert len(by_user[6]) == 3 and 7 not in by_user
    assert len(by_user[8]) == 8 and len(set(by_user[8])) == 4
    assert all(0 <= i < tweets.ID_RANGE for i in by_user[6])


def test_author_followers_are_as_many_as_the_profile_says(spark):
    schema = tweets_in.TWEET_SCHEMA
    one = spark.createDataFrame([(1, (5, 12_000), "t", None, None)], schema)
    none = spark.createDataFrame([], "user_id bigint, ids array<bigint>")
    assert tweets.follower_edges(one, none).count() == 12_000
    assert tweets.follower_edges(one, none, author_limit=7).count() == 7


# --- generators --------------------------------------------------------------


@pytest.mark.parametrize("profile", [generate.CHURN, generate.GROWTH, generate.TINY])
def test_generated_commands_follow_their_profile(spark, profile):
    rows = generate.generate(spark, 50_000, profile, seed=3, batch_size=10_000)
    assert all(r["within"] for r in generate.mix_report(rows, profile, 0.01).collect())
    assert {r["batch_id"]: r["count"] for r in rows.groupBy("batch_id").count().collect()} == {
        b: 10_000 for b in range(5)
    }
    shape = rows.agg(F.min("src"), F.max("src"), F.min("dst"), F.max("dst")).first()
    assert min(shape) >= 0 and max(shape) < profile.ids
    again = generate.random_commands(spark.range(0, 50_000, 1, 13), "id", profile, 3, 10_000)
    assert rows.exceptAll(again).isEmpty()
    other = generate.generate(spark, 50_000, profile, seed=4, batch_size=10_000)
    assert not rows.exceptAll(other).isEmpty()
