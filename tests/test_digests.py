"""Saved graphs compared by their digests."""

import shutil

from replay import ROW, random_rows

from tidegraph.model import EDGE_SCHEMA, Graph, empty_graph
from tidegraph.operators import compare
from tidegraph.operators.marks import build_graph
from tidegraph.sources import digests


def built(spark, rows):
    return build_graph(spark.createDataFrame(rows, ROW), "ordered")


def test_comparisons_read_digests_and_differing_buckets_only(spark, tmp_path):
    root, rows = str(tmp_path / "saved"), random_rows(51, 300, ids=40)
    old = built(spark, rows)
    some = old.edges.first()
    changed = old.edges.filter(
        (old.edges.src != some["src"]) | (old.edges.dst != some["dst"]) | (old.edges.attr != some["attr"])
    ).unionByName(spark.createDataFrame([(1, 2, "new")], EDGE_SCHEMA))
    new = Graph(old.vertices, changed)
    digests.write_digested(old, root, 1)
    digests.write_digested(Graph(old.vertices.repartition(3), old.edges.repartition(5)), root, 2)
    digests.write_digested(new, root, 3)
    report = lambda a, b: tuple(digests.stored_graphs_equal(spark, root, a, b).first())
    assert report(1, 2) == (True, 0, 0) and report(1, 1) == (True, 0, 0)
    equal, vertex_buckets, edge_buckets = report(1, 3)
    assert not equal and vertex_buckets == 0 and edge_buckets in (1, 2)
    expected = sorted(map(tuple, compare.edge_diff(old, new).collect()))
    assert sorted(map(tuple, digests.stored_diff(spark, root, 1, 3).collect())) == expected
    # all that did not change can be gone
    differ = {r["bucket"] for r in digests.differing_buckets(spark, root, 1, 3).collect()}
    for folder in (tmp_path / "saved" / "rows").glob("*/snapshot_ts=*/bucket=*"):
        if folder.parts[-3] == "vertices" or int(folder.name.removeprefix("bucket=")) not in differ:
            shutil.rmtree(folder)
    assert sorted(map(tuple, digests.stored_diff(spark, root, 1, 3).collect())) == expected
    assert report(1, 2) == (True, 0, 0)


def test_copies_and_empty_graphs(spark, tmp_path):
    root = str(tmp_path / "saved")
    one = spark.createDataFrame([(1, 2, "a"), (3, 4, "b")], EDGE_SCHEMA)
    vertices = spark.createDataFrame([(1, 1)], "id long, attr long")
    digests.write_digested(empty_graph(spark), root, 0)
    digests.write_digested(Graph(vertices, one), root, 1)
    digests.write_digested(Graph(vertices, one.union(one)), root, 2)  # copies are told apart
    equal = lambda a, b: digests.stored_graphs_equal(spark, root, a, b).first()["equal"]
    assert equal(0, 0) and not equal(0, 1) and not equal(1, 2)
    got = sorted(map(tuple, digests.stored_diff(spark, root, 0, 1).collect()))
    assert got == [("added", 1, 2, "a"), ("added", 3, 4, "b")]
    assert [tuple(r) for r in digests.stored_diff(spark, root, 1, 0, "vertices").collect()] == [("removed", 1, 1)]
