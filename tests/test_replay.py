"""The closed form must equal replaying commands one by one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from replay import ROW, as_sets, bags_in_batches, in_batches, in_order, random_rows

from tidegraph.model import empty_graph
from tidegraph.operators import graph as ops
from tidegraph.operators import marks, reduction, series, temporal

SEEDS = range(3)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


@pytest.mark.parametrize("seed", SEEDS)
def test_both_orders(spark, seed):
    rows = random_rows(seed, 80)
    commands = frame(spark, rows)
    assert as_sets(marks.build_graph(commands, "ordered")) == in_order(rows)
    assert as_sets(marks.build_graph(commands, "batch")) == in_batches(rows)[:2]
    for few in (0, 1000):
        early = marks.build_graph(commands, "ordered", prune_early=bool(few))
        assert as_sets(early) == in_order(rows)
        early = marks.build_graph(commands, "batch", prune_early=bool(few))
        assert as_sets(early) == in_batches(rows)[:2]


@pytest.mark.parametrize("seed", SEEDS)
def test_many_histories_at_once(spark, seed):
    """Two hundred short histories in one table, kept apart by their ids."""
    rows, vertices, edges = [], set(), set()
    rng = random.Random(seed)
    for part in range(200):
        own = random_rows(rng.random(), 12, ids=3, labels="a")
        shift = part * 10
        own = [
            (s, b, op, src + shift, attr, None if dst is None else dst + shift)
            for s, b, op, src, attr, dst in own
        ]
        v, e = in_order(own)
        vertices |= v
        edges |= e
        rows += own
    assert as_sets(marks.build_graph(frame(spark, rows), "ordered")) == (vertices, edges)
    reduced = reduction.net_effect(frame(spark, rows))
    assert as_sets(marks.build_graph(reduced, "batch")) == (vertices, edges)


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("shards", [1, 3])
def test_reduced_batches_and_shards(spark, seed, shards):
    rows = random_rows(seed + 50, 90)
    routed = reduction.route_to_shards(frame(spark, rows), shards)
    reduced = reduction.net_effect(routed, ("batch_id", "shard"))
    combined = reduction.combine_shards(reduced)
    assert as_sets(marks.build_graph(combined, "batch")) == in_order(rows)


def test_reduction_is_small_and_distinct(spark):
    rows = random_rows(7, 300, batch=100)
    reduced = reduction.net_effect(frame(spark, rows)).drop("ts")
    assert reduced.count() == reduced.distinct().count() < 300


def test_reduction_rules_case_by_case(spark):
    def reduce(*lines):
        rows = []
        for i, line in enumerate(lines):
            t = line.split()
            edge = len(t) == 4
            rows.append((i, 0, t[0], int(t[1]), t[2] if edge else None, int(t[3]) if edge else None))
        out = reduction.net_effect(frame(spark, rows)).collect()
        return {
            " ".join(str(x) for x in (r["op"], r["src"], r["attr"], r["dst"]) if x is not None)
            for r in out
        }

    assert reduce("addEdge 1 a 2", "rmvNode 1") == {"addNode 2", "rmvNode 1"}
    assert reduce("addEdge 1 a 2", "rmvNode 2") == {"addNode 1", "rmvNode 2"}
    assert reduce("addEdge 1 a 2", "rmvNode 1", "rmvNode 2") == {"rmvNode 1", "rmvNode 2"}
    assert reduce("addEdge 1 a 2", "rmvEdge 1 a 2") == {"addNode 1", "addNode 2", "rmvEdge 1 a 2"}
    assert reduce("addNode 1", "rmvNode 1") == {"rmvNode 1"}
    assert reduce("rmvNode 1", "addNode 1") == {"rmvNode 1", "addNode 1"}
    assert reduce("rmvEdge 1 a 2", "addEdge 1 a 2") == {"addEdge 1 a 2"}
    assert reduce("rmvEdge 1 a 2", "rmvNode 2") == {"rmvNode 2"}
    assert reduce("rmvNode 1", "rmvNode 1") == {"rmvNode 1"}
    assert reduce("addEdge 1 a 1", "rmvEdge 1 a 1") == {"addNode 1", "rmvEdge 1 a 1"}
    assert reduce("addEdge 1 a 2", "rmvEdge 1 b 2") == {"addEdge 1 a 2", "rmvEdge 1 b 2"}


@pytest.mark.parametrize("seed", SEEDS)
def test_order_repetition_and_lateness_do_not_matter(spark, seed):
    rows = random_rows(seed + 100, 60)
    mixed = rows + random.Random(seed).choices(rows, k=30)
    random.Random(seed).shuffle(mixed)
    assert as_sets(marks.build_graph(frame(spark, mixed), "ordered")) == in_order(rows)
    halves = [mixed[: len(mixed) // 3], mixed[len(mixed) // 3 :]]
    merged = marks.graph_from_marks(
        marks.merge_marks(*[marks.edge_marks(frame(spark, h), "batch") for h in halves]),
        marks.merge_marks(*[marks.vertex_marks(frame(spark, h), "batch") for h in halves]),
        "batch",
    )
    assert as_sets(merged) == in_batches(rows)[:2]


@pytest.mark.parametrize("seed", SEEDS)
def test_count_series(spark, seed):
    rows = random_rows(seed + 200, 120)
    commands = frame(spark, rows)
    tuples = lambda df: sorted(tuple(r) for r in df.collect())
    assert tuples(series.count_series(commands)) == in_batches(rows)[2]
    assert tuples(series.count_series(commands, copies=True)) == bags_in_batches(rows)[2]


@pytest.mark.parametrize("seed", SEEDS)
def test_copies(spark, seed):
    rows = random_rows(seed + 300, 120)
    vertices, edges, _ = bags_in_batches(rows)
    found = series.edge_copies(frame(spark, rows), "batch").collect()
    assert {(r["src"], r["attr"], r["dst"]): r["copies"] for r in found} == Counter(edges)
    found = series.vertex_copies(frame(spark, rows), "batch").collect()
    assert {r["id"]: r["copies"] for r in found} == Counter(vertices)


def test_running_totals_across_buckets(spark):
    values = {k * k: k - 50 for k in range(100)}
    df = spark.createDataFrame(list(values.items()), "k bigint, v bigint")
    got = {r["k"]: r["v"] for r in series.running_totals(df, "k", ["v"], width=7).collect()}
    total, expected = 0, {}
    for k in sorted(values):
        total += values[k]
        expected[k] = total
    assert got == expected


@pytest.mark.parametrize("seed", SEEDS)
def test_fold_equals_batch_by_batch_application(spark, seed):
    rows = random_rows(seed + 400, 30)
    state = empty_graph(spark)
    for batch in range(3):
        state = ops.apply_batch(state, frame(spark, rows).filter(F.col("batch_id") == batch))
    assert as_sets(state) == in_batches(rows)[:2]


def test_as_of_and_start_state(spark):
    rows = random_rows(9, 90)
    commands = frame(spark, rows)
    for batch in (0, 4, 8):
        early = [r for r in rows if r[1] <= batch]
        assert as_sets(temporal.graph_as_of_batch(commands, batch)) == in_batches(early)[:2]
    assert as_sets(temporal.graph_as_of_seq(commands, 33)) == in_order(rows[:33])

    saved = temporal.graph_as_of_batch(commands, 4)
    later = commands.filter("batch_id > 4").select(*ops.as_start_commands(saved).drop("ts").columns)
    start = ops.as_start_commands(saved).drop("ts")
    assert as_sets(marks.build_graph(start.unionByName(later), "batch")) == in_batches(rows)[:2]


def test_ties_within_a_batch(spark):
    rows = [(1, 0, "addEdge", 1, "a", 2), (2, 0, "rmvEdge", 1, "a", 2), (3, 0, "rmvNode", 2, None, None)]
    assert as_sets(marks.build_graph(frame(spark, rows), "ordered")) == ({1}, set())
    assert as_sets(marks.build_graph(frame(spark, rows), "batch")) == ({1, 2}, {(1, "a", 2)})
