"""Nearest snapshots, request times and expiry against plain definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.functions.times import epoch_micros, micros_to_timestamp, parse_request_time
from tidegraph.operators import expiry, temporal

T0 = dt.datetime(2024, 1, 1)


def names(spark, *values):
    return spark.createDataFrame([(str(v),) for v in values], "name string")


def test_nearest_snapshot_of_one_time(spark):
    near = lambda at, *v: [r["name"] for r in temporal.nearest_snapshot(names(spark, *v), at).collect()]
    assert near(150, 300, 200, 100, "gen", "1x") == ["100"]
    assert near(151, 300, 200, 100) == ["200"]
    assert near(10_000, 300, 200) == ["300"]
    assert near(5, "gen", "old") == []


@pytest.mark.parametrize("bucket", [1, 7, 50, 1 << 20])
def test_nearest_snapshots_of_many_times(spark, bucket):
    rng = random.Random(bucket)
    saved = sorted({rng.randrange(-200, 1000) for _ in range(25)})
    probes = [rng.randrange(-400, 1300) for _ in range(200)] + [500] * 50
    expected = sorted((p, min(saved, key=lambda s: (abs(s - p), s))) for p in probes)
    found = temporal.nearest_snapshots(
        spark.createDataFrame([(p,) for p in probes], "at bigint"),
        "at",
        spark.createDataFrame([(s,) for s in saved + saved[:3]], "snapshot_ts bigint"),
        bucket_millis=bucket,
    )
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_no_snapshots_at_all(spark):
    found = temporal.nearest_snapshots(
        spark.createDataFrame([(1,), (None,)], "at bigint"),
        "at",
        spark.createDataFrame([], "snapshot_ts bigint"),
    )
    assert [r["nearest_ts"] for r in found.collect()] == [None, None]


def test_request_times(spark):
    asked = spark.createDataFrame(
        [("2016-02-09 23:32:46",), ("1969-12-31 23:59:59",), ("today",), ("2016-02-30 00:00:00",)],
        "t string",
    )
    got = [r[0] for r in asked.select(parse_request_time(F.col("t"))).collect()]
    assert got == [1455060766000, -1000, None, None]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_micros_round_trip(spark, kind):
    stamps = [dt.datetime(1969, 7, 20, 20, 17, 40, 123456), T0, dt.datetime(2030, 12, 31, 23, 59, 59, 999999)]
    df = spark.createDataFrame([(s,) for s in stamps], f"ts {kind}")
    us = df.withColumn("us", epoch_micros(df, "ts"))
    back = us.select("ts", micros_to_timestamp(df, "ts", F.col("us")).alias("back"))
    assert back.filter(F.col("ts") != F.col("back")).isEmpty()
    first = us.orderBy("ts").first()["us"]
    assert first == (stamps[0] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def additions(spark, rows):
    data = [(T0 + dt.timedelta(seconds=s), "addEdge", 1, label, 2) for label, s in rows]
    return spark.createDataFrame(data, "ts timestamp_ntz, op string, src bigint, attr string, dst bigint")


@pytest.mark.parametrize("seed", range(3))
def test_expiry_commands(spark, seed):
    rng, ttl, until = random.Random(seed), 10, 300
    rows = [(rng.choice("abcdef"), rng.randrange(0, 320)) for _ in range(150)]
    expected = set()
    for label in {r[0] for r in rows}:
        times = sorted(s for a, s in rows if a == label and s <= until)
        for now, following in zip(times, times[1:] + [10**9]):
            if following > now + ttl and now + ttl < until:
                expected.add((label, now + ttl))
    end = F.lit(T0 + dt.timedelta(seconds=until)).cast("timestamp_ntz")
    found = expiry.expiry_commands(additions(spark, rows), ttl, end).collect()
    assert {(r["attr"], (r["ts"] - T0).total_seconds()) for r in found} == expected
    assert len(found) == len(expected)


def test_an_edge_exactly_that_old_stays(spark):
    schema = "seq bigint, ts timestamp_ntz, op string, src bigint, attr string, dst bigint"
    rows = [
        (1, T0, "addEdge", 1, "old", 2),
        (2, T0 + dt.timedelta(seconds=1), "addEdge", 1, "edge", 2),
        (3, T0 + dt.timedelta(seconds=2), "addEdge", 1, "gone", 2),
        (4, T0 + dt.timedelta(seconds=3), "rmvEdge", 1, "gone", 2),
        (5, T0 + dt.timedelta(seconds=99), "addEdge", 1, "future", 2),
    ]
    commands = spark.createDataFrame(rows, schema)
    at = F.lit(T0 + dt.timedelta(seconds=11)).cast("timestamp_ntz")
    assert [r["attr"] for r in expiry.expired_edges(commands, 10, at).collect()] == ["old"]
    g = expiry.graph_with_expiry(commands, 10, at)
    assert [r["attr"] for r in g.edges.collect()] == ["edge"]
    assert {r["id"] for r in g.vertices.collect()} == {1, 2}
