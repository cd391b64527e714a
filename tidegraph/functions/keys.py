"""Join keys that leave room for splitting hot ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def own_shuffle(key: str | Column) -> Column:
    """A whole-number key with its value unchanged but its origin hidden.

    Adaptive execution splits a hot key of a join only if both inputs come
    straight from a shuffle made for that join. A table just aggregated by the
    key would be joined where it lies, without one, and the hot key of the
    other input would stay in one task. Joining on this form of the key moves
    the aggregated table once more, and it is the small one.
    """
    key = F.col(key) if isinstance(key, str) else key
    return key.bitwiseOR(F.lit(0).cast("bigint"))


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys, for joins that only ask whether a key is there.

    Copies of a hot key are dropped before they are shuffled, and one key is
    passed through :func:`own_shuffle` (or its like for text).
    """
    distinct = df.select(*keys).distinct()
    for key in keys:
        kind = df.schema[key].dataType
        if isinstance(kind, T.LongType):
            return distinct.withColumn(key, own_shuffle(key))
    for key in keys:
        if isinstance(df.schema[key].dataType, T.StringType):
            return distinct.withColumn(key, F.concat(key, F.lit("")))
    return distinct
