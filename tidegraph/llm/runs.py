"""Rows that follow each other with the same key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], *key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Successive rows with equal key columns, from rows sorted by them."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            this = tuple(row[k] for k in key)
            if this != at:
                if rows:
                    yield at, rows
                at, rows = this, []
            rows.append(row)
    if rows:
        yield at, rows
