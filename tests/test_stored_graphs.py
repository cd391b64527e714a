"""Stored command files must give the stored graphs."""

import pytest
from conftest import stored_fixtures
from pyspark.sql import functions as F
from replay import as_sets

from tidegraph.operators import compare, marks, reduction
from tidegraph.sources import commands as lines_in
from tidegraph.sources import snapshots

FIXTURES = stored_fixtures()
IDS = [f"stored{i}" for i in range(len(FIXTURES))]
NUMBERED = [f for f in FIXTURES if "." not in f.source.rsplit("/", 1)[-1]]


def _expected(spark, fixture):
    root, name = fixture.expected.rsplit("/", 1)
    return snapshots.read_snapshot_text(spark, root, name)


def _commands(spark, fixture):
    if fixture in NUMBERED:
        return lines_in.read_numbered_batches(spark, fixture.source)
    rows = lines_in.parse_commands(lines_in.read_lines(spark, fixture.source))
    return rows.withColumnRenamed("line_no", "seq").withColumn(
        "batch_id", F.lit(0).cast("long")
    )


@pytest.mark.parametrize("fixture", FIXTURES, ids=IDS)
def test_batches_give_the_stored_graph(spark, fixture):
    commands = _commands(spark, fixture).cache()
    assert commands.count() == fixture.n_commands
    built, expected = marks.build_graph(commands, "batch"), _expected(spark, fixture)
    report = compare.graphs_equal(built, expected).first()
    assert report["equal"], report
    strict = compare.graphs_equal_by_counts(built, expected).first()
    assert strict["equal"]
    assert (strict["vertices_left"], strict["edges_left"]) == (fixture.n_vertices, fixture.n_edges)
    assert compare.graph_contained(built, expected).first()["contained"]
    commands.unpersist()


@pytest.mark.parametrize("fixture", [f for f in FIXTURES if "both modes" in f.modes])
def test_line_order_gives_the_stored_graph(spark, fixture):
    commands = _commands(spark, fixture)
    expected = as_sets(_expected(spark, fixture))
    assert as_sets(marks.build_graph(commands, "ordered")) == expected
    reduced = reduction.net_effect(commands)
    assert as_sets(marks.build_graph(reduced, "batch")) == expected


def test_two_batchings_of_one_history_agree(spark):
    """Inputs that share an expected graph were cut into batches differently."""
    groups = {}
    for f in FIXTURES:
        groups.setdefault(f.expected, []).append(f)
    pairs = [g for g in groups.values() if len(g) > 1]
    if not pairs:
        pytest.skip("no stored history is cut in two ways")
    for first, second, *_ in pairs:
        graphs = [marks.build_graph(_commands(spark, f), "batch") for f in (first, second)]
        assert compare.graphs_equal(*graphs).first()["equal"]
