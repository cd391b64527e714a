"""Repeatable pseudo-random draws.

A draw is a hash of a key and a salt, not a stream of a random generator, so
it gives the same value wherever and however often a row is computed: after an
executor is lost, in another partitioning, on another run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 1 << 53


def uniform(*key: Column, salt: str) -> Column:
    """A double in [0, 1) fixed by the key and the salt."""
    return F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(_STEPS)) / F.lit(float(_STEPS))


def integer_below(bound: int | Column, *key: Column, salt: str) -> Column:
    """A long in [0, bound) fixed by the key and the salt."""
    bound = F.lit(bound) if isinstance(bound, int) else bound
    return F.floor(uniform(*key, salt=salt) * bound).cast("long")
