"""The plain definition of the commands, one by one, for small inputs."""

from __future__ import annotations

import random

ROW = "seq bigint, batch_id bigint, op string, src bigint, attr string, dst bigint"


def random_rows(seed: int, n: int, ids: int = 6, labels: str = "ab", batch: int = 10) -> list[tuple]:
    """Commands over few ids, so that they often undo each other."""
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        op = rng.choices(["addEdge", "addNode", "rmvEdge", "rmvNode"], [5, 2, 3, 2])[0]
        edge = op.endswith("Edge")
        rows.append(
            (
                seq,
                (seq - 1) // batch,
                op,
                rng.randrange(ids),
                rng.choice(labels) if edge else None,
                rng.randrange(ids) if edge else None,
            )
        )
    return rows


def step(row: tuple, vertices: set, edges: set) -> None:
    _, _, op, src, attr, dst = row
    if op == "addNode":
        vertices.add(src)
    elif op == "addEdge":
        vertices.update((src, dst))
        edges.add((src, attr, dst))
    elif op == "rmvEdge":
        edges.discard((src, attr, dst))
    else:
        vertices.discard(src)
        for e in [e for e in edges if src in (e[0], e[2])]:
            edges.discard(e)


def in_order(rows: list[tuple]) -> tuple[set, set]:
    vertices, edges = set(), set()
    for row in sorted(rows):
        step(row, vertices, edges)
    return vertices, edges


def in_batches(rows: list[tuple]) -> tuple[set, set, list[tuple]]:
    """Removals, then additions, batch by batch; and the counts after each."""
    vertices, edges, series = set(), set(), []
    for batch in sorted({r[1] for r in rows}):
        mine = [r for r in rows if r[1] == batch]
        for row in mine:
            if row[2].startswith("rmv"):
                step(row, vertices, edges)
        for row in mine:
            if row[2].startswith("add"):
                step(row, vertices, edges)
        series.append((batch, len(edges), len(vertices)))
    return vertices, edges, series


def bags_in_batches(rows: list[tuple]) -> tuple[list, list, list[tuple]]:
    """As above, with copies: additions pile up, removals take all copies."""
    vertices, edges, series = [], [], []
    for batch in sorted({r[1] for r in rows}):
        mine = [r for r in rows if r[1] == batch]
        cut = {r[3:] for r in mine if r[2] == "rmvEdge"}
        gone = {r[3] for r in mine if r[2] == "rmvNode"}
        edges = [e for e in edges if e not in cut and e[0] not in gone and e[2] not in gone]
        vertices = [v for v in vertices if v not in gone]
        for r in mine:
            if r[2] == "addEdge":
                edges.append(r[3:])
                vertices += [r[3], r[5]]
            elif r[2] == "addNode":
                vertices.append(r[3])
        series.append((batch, len(edges), len(vertices)))
    return vertices, edges, series


def as_sets(graph) -> tuple[set, set]:
    """A Spark graph as Python sets; fails if it holds a row twice."""
    vertices = [r["id"] for r in graph.vertices.collect()]
    edges = [(r["src"], r["attr"], r["dst"]) for r in graph.edges.collect()]
    assert len(vertices) == len(set(vertices)) and len(edges) == len(set(edges))
    return set(vertices), set(edges)
