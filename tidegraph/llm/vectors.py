"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors are projected on many random lines. An order sorts them by one line,
inside cells given by the signs on a few others, and a pair collides in the order
if it shares the cell and one lies in the other's window on the line. Pairs that
collide often enough over all orders are verified by their cosine.

How many orders, and how many collisions are enough, follows from the wanted
recall: for two vectors at the threshold the chance of a collision in one order is
known, so the number of collisions is binomial, and ``ORDERS`` is the least number
for which ``COLLISIONS`` or more happen with ``RECALL``. The number of signs grows
with the logarithm of the vectors, so that cells keep their size and the work per
vector stays the same but for the number of orders.

Whether a pair collides in an order depends on the two vectors alone. So a task
that holds both knows their collisions in all orders; it verifies a pair only in
the first order in which it collides, and counts each link once without bringing
pairs together. Equal vectors are one node with a weight. A cell of more than
``BLOCK`` nodes is dealt out as pairs of slices. Tasks return link counts per node
and enough links to connect what is linked, never all pairs.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components has no links and is its own component; vectors of different lengths
are never linked; rows with one id and different vectors are different vectors;
a row without an id takes no part (component null, not kept). An empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.components import components
from tidegraph.llm.runs import runs
from tidegraph.llm.scratch import Scratch
from tidegraph.llm.workers import ship_package

THRESHOLD = 0.9
RECALL = 0.995  # of pairs just at the threshold; closer ones are found more surely
COLLISIONS = 2
CELL, BLOCK = 1024, 2048
WINDOW = 1.5  # half-width, in standard deviations of a pair's distance at the threshold
BROADCAST_CELLS = 20_000
SEED = 11


@dataclass(frozen=True)
class Calibration:
    signs: int
    orders: int
    collisions: int
    half_width: float
    threshold: float


def calibrate(n: int, threshold: float = THRESHOLD, recall: float = RECALL,
              collisions: int = COLLISIONS) -> Calibration:
    """The signs per order for ``n`` vectors, and the orders needed for the recall."""
    signs = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    spread = math.sqrt(2 - 2 * threshold)
    same_sign = 1 - math.acos(threshold) / math.pi
    p = same_sign**signs * math.erf(WINDOW / math.sqrt(2))
    orders = collisions
    while sum(math.comb(orders, i) * p**i * (1 - p) ** (orders - i) for i in range(collisions)) > 1 - recall:
        orders += 1
    return Calibration(signs, orders, collisions, WINDOW * spread, threshold)


def projections(x: np.ndarray, c: Calibration) -> tuple[np.ndarray, np.ndarray]:
    """Cells and places of unit vectors in every order: two (vectors, orders) arrays."""
    n, d = x.shape
    lines = np.random.default_rng((SEED, d)).normal(size=(d, c.orders * (c.signs + 1)))
    on = (x @ lines).reshape(n, c.orders, c.signs + 1)
    cells = np.zeros((n, c.orders), np.int64)
    for s in range(c.signs):
        cells = cells * 2 + (on[:, :, s] > 0)
    return cells, on[:, :, -1]


def _by_length(batches: Iterator[pa.RecordBatch]):
    """Nodes, weights and unit vectors, for each length of vector in a batch."""
    for batch in batches:
        nodes, weights = np.array(batch.column(0)), np.array(batch.column(1))
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(np.concatenate(([0], sizes)))
        flat = np.asarray(batch.column(2).flatten(), np.float64)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = flat[starts[at][:, None] + np.arange(d)]
            x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths beyond double range
            yield int(d), nodes[at], weights[at], x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _count_cells(batches: Iterator[pa.RecordBatch], c: Calibration) -> Iterator[pa.RecordBatch]:
    for d, _, _, x in _by_length(batches):
        cells, _ = projections(x, c)
        for order in range(c.orders):
            found, n = np.unique(cells[:, order], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), d, np.int32)), pa.array(np.full(len(found), order, np.int32)),
                 pa.array(found), pa.array(n)], names=["d", "order", "cell", "n"])


def _deal(batches: Iterator[pa.RecordBatch], c: Calibration) -> Iterator[pa.RecordBatch]:
    for d, nodes, weights, x in _by_length(batches):
        cells, _ = projections(x, c)
        for at in range(0, len(x), 256):
            raw = pa.array([row.tobytes() for row in x[at : at + 256]], pa.binary())
            n = len(raw)
            for order in range(c.orders):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, order, np.int32)),
                     pa.array(cells[at : at + n, order]), pa.array(nodes[at : at + n]),
                     pa.array(weights[at : at + n]), raw],
                    names=["d", "order", "cell", "node", "weight", "vector"])


LINKS = "a long, b long, n_links long"


def _linked(order: int, nodes, weights, slices, x, pair: tuple[int, int], c: Calibration):
    """Link counts by row, and connecting links, among the rows of a cell."""
    cells, places = projections(x, c)
    by_place = np.argsort(places[:, order], kind="stable")
    nodes, weights, slices, x = nodes[by_place], weights[by_place], slices[by_place], x[by_place]
    cells, places = cells[by_place], places[by_place]
    n, line = len(nodes), places[:, order]
    counts, root, links = np.zeros(n, np.int64), np.arange(n), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach = np.searchsorted(line, line + c.half_width, side="right")
    for at in range(0, n, 128):
        i = np.arange(at, min(at + 128, n))
        j = np.arange(at, reach[i[-1]])
        times = np.zeros((len(i), len(j)), np.int16)
        earlier = np.zeros(times.shape, bool)
        for o in range(c.orders):
            hit = (cells[i, o][:, None] == cells[j, o]) & (
                np.abs(places[i, o][:, None] - places[j, o]) <= c.half_width)
            times += hit
            if o < order:
                earlier |= hit
            elif o == order:
                here = hit & ~earlier
        wanted = here & (times >= c.collisions) & (i[:, None] < j)
        if pair[0] != pair[1]:
            wanted &= slices[i][:, None] != slices[j]
        if not wanted.any():
            continue
        wanted &= x[i] @ x[j].T >= c.threshold
        counts[i] += wanted @ weights[j]
        np.add.at(counts, j, weights[i] @ wanted)
        for a, b in zip(*np.nonzero(wanted)):
            u, v = find(at + int(a)), find(at + int(b))
            if u != v:
                root[max(u, v)] = min(u, v)
                links.append((int(nodes[at + a]), int(nodes[at + b])))
    return nodes, counts, links


def _link(batches: Iterator[pa.RecordBatch], c: Calibration) -> Iterator[pa.RecordBatch]:
    # d, order, cell, first slice, second slice, node, weight, slice, vector
    for (_, order, _, *pair), rows in runs(batches, 0, 1, 2, 3, 4):
        nodes, weights, slices = (np.array(col, np.int64) for col in list(zip(*rows))[5:8])
        x = np.frombuffer(b"".join(r[8] for r in rows), np.float64).reshape(len(rows), -1)
        nodes, counts, links = _linked(order, nodes, weights, slices, x, tuple(pair), c)
        some = np.flatnonzero(counts)
        a = [u for u, _ in links] + nodes[some].tolist()
        b = [v for _, v in links] + [None] * len(some)
        n = [None] * len(links) + counts[some].tolist()
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
                names=["a", "b", "n_links"])


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD,
                           recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``."""
    ship_package(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(
        ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        & F.exists("v", lambda e: e != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    nodes = scratch.save(
        rows.where(sound).groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    c = calibrate(nodes.count(), threshold, recall)
    weighed = nodes.select("node", "weight", "v")
    sizes = weighed.mapInArrow(
        lambda b: _count_cells(b, c), "d int, order int, cell long, n long"
    ).groupBy("d", "order", "cell").agg(F.sum("n").alias("n"))
    hot = scratch.save(sizes.where(F.col("n") > BLOCK).select(
        "d", "order", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_slices")))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_CELLS else hot
    dealt = weighed.mapInArrow(
        lambda b: _deal(b, c), "d int, order int, cell long, node long, weight long, vector binary"
    ).join(hot, ["d", "order", "cell"], "left").withColumn("n_slices", F.coalesce("n_slices", F.lit(1)))
    sliced = dealt.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("n_slices"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slices") - F.lit(1).cast("long"))))
    keys = ["d", "order", "cell", "s", "t"]
    tasks = sliced.withColumn("s", F.least("slice", "other")).withColumn("t", F.greatest("slice", "other"))
    found = scratch.save(
        tasks.select(*keys, "node", "weight", "slice", "vector").repartition(*keys)
        .sortWithinPartitions(*keys).mapInArrow(lambda b: _link(b, c), LINKS)
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n"))
    parts = components(found.where("b is not null").select("a", "b"), scratch)
    known = (
        nodes.join(counts, "node", "left").join(parts, "node", "left")
        .select("v", "least", F.coalesce("component", "node").alias("component"),
                (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("v", "n", "component_id")
    joined = rows.where(sound).join(known, "v").select("vec_id", "n", "component_id")
    # n is of the vector's class without itself
    odd = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n"),
                                    F.col("vec_id").alias("component_id"))
    return joined.unionByName(odd).select(
        "vec_id", F.col("n").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
