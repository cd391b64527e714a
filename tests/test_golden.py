"""Graphs written out by hand, that need no files from elsewhere."""

from pathlib import Path

import pytest
from replay import as_sets

from tidegraph.operators.compare import graphs_equal
from tidegraph.operators.marks import build_graph
from tidegraph.sources import replay
from tidegraph.sources.commands import read_numbered_batches
from tidegraph.sources.snapshots import read_snapshot_text
from tidegraph.streaming import jobs
from tidegraph.streaming.store import GraphStore

GOLDEN = Path(__file__).parent / "golden"


@pytest.fixture(scope="module")
def expected(spark):
    return read_snapshot_text(spark, str(GOLDEN), "expected")


def test_the_stored_graph(expected):
    assert as_sets(expected) == (
        set(range(1, 7)), {(4, "knows", 1), (5, "a,b", 6), (6, "likes", 1), (2, "knows", 4)})


def test_batches_give_the_stored_graph(spark, expected):
    built = build_graph(read_numbered_batches(spark, str(GOLDEN / "batches")), "batch")
    assert graphs_equal(built, expected).first()["equal"]


def test_replayed_files_give_the_stored_graph(spark, expected, tmp_path):
    store = GraphStore(spark, str(tmp_path / "marks"), buckets=2)
    jobs.until_caught_up(jobs.run_replay(
        replay.numbered_files(spark, str(GOLDEN / "batches")), store, str(tmp_path / "progress"),
        {"processingTime": "0 seconds"}))
    assert graphs_equal(store.graph(), expected).first()["equal"]
    assert store.totals() == (4, 6)
