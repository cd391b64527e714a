"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. The
queries run over the whole tables; results go to Spark's no-op sink, so every
row is computed and none is collected. ``BENCH_GENERATED_BATCHES`` batches of a
million generated commands each (0 to skip) are then applied one after the other
to a stored graph that grows, with its counts after each, as the recorded per-batch
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidegraph.operators import generate  # noqa: E402
from tidegraph.operators.graph import counts  # noqa: E402
from tidegraph.plans import catalog  # noqa: E402
from tidegraph.plans.time_queries import scratch_folder  # noqa: E402
from tidegraph.session import build_session  # noqa: E402
from tidegraph.streaming.store import GraphStore  # noqa: E402

HEADLINE = (
    "graph_edges_ordered graph_vertices_ordered graph_edges_batch graph_edges_pruned_early "
    "graph_vertices_batch net_effect_commands graph_of_reduced_batches "
    "framed_batches parse_lines count_series count_series_with_copies edge_copies_batch "
    "merge_parallel_edges triplets subgraph graphs_equal edge_diff nearest_snapshots "
    "edges_as_of_time expired_edges expiry_commands mention_edges follower_edges "
    "word_counts streamed_edges_ordered streamed_expiry"
).split()

BATCH = 1_000_000


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def generated(spark, batches: int) -> list[float]:
    """Seconds for each batch of a generated history: apply it to the stored
    graph, and count the vertices and edges there are then."""
    path = scratch_folder(spark, "bench-generated")
    generate.generate(spark, batches * BATCH, generate.GROWTH, batch_size=BATCH).write.partitionBy(
        "batch_id"
    ).parquet(f"{path}/in")
    store, times = GraphStore(spark, f"{path}/marks", "batch", buckets=8), []
    for number in range(batches):
        commands = spark.read.parquet(f"{path}/in/batch_id={number}").withColumn(
            "batch_id", F.lit(number).cast("long"))

        def apply(number=number, commands=commands) -> None:
            store.append(commands, number)
            if (number + 1) % 8 == 0:
                # batches come in their order, so what is gone is gone for good
                store.compact(number, settled=number + 1)
                store.prune(keep_bases=2)
            store.totals()

        times.append(timed(apply))
    counted = counts(store.graph()).first()
    if (counted["n_edges"], counted["n_vertices"]) != store.totals():
        raise AssertionError(f"{counted} are not the totals kept: {store.totals()}")
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    batches = int(os.environ.get("BENCH_GENERATED_BATCHES", "36"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        8,
        {"spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    consume(catalog.QUERIES[HEADLINE[0]](spark, sf_dir))  # start-up is not a query

    times = {
        name: timed(lambda name=name: consume(catalog.QUERIES[name](spark, sf_dir)))
        for name in HEADLINE
    }
    total = round(sum(times.values()), 3)
    line = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if batches:
        times = generated(spark, batches)
        line["sec_per_generated_batch"] = times
        line["sec_per_generated_batch_mean"] = round(sum(times) / batches, 3)
    spark.stop()
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
