"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the date-time format accepted by load requests.
REQUEST_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_request_time(text: Column) -> Column:
    """Epoch milliseconds of ``yyyy-MM-dd HH:mm:ss`` in UTC; null if malformed."""
    stamped = F.concat(F.trim(text), F.lit("+00:00"))
    return F.unix_millis(F.try_to_timestamp(stamped, F.lit(REQUEST_FORMAT + "XXX")))


def _since_epoch(df: DataFrame, column: str, unit: str) -> Column:
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.expr(
            f"timestampdiff({unit}, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)"
        )
    return F.unix_millis(column) if unit == "MILLISECOND" else F.unix_micros(column)


def epoch_millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of a timestamp column, with or without time zone."""
    return _since_epoch(df, column, "MILLISECOND")


def epoch_micros(df: DataFrame, column: str) -> Column:
    """Epoch microseconds of a timestamp column, with or without time zone."""
    return _since_epoch(df, column, "MICROSECOND")


def micros_to_timestamp(df: DataFrame, column: str, micros: Column) -> Column:
    """A timestamp of the same kind as ``df[column]`` from epoch microseconds."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        day = 86_400_000_000
        rest = F.pmod(micros, F.lit(day))
        return F.timestamp_add(
            "MICROSECOND",
            rest,
            F.timestamp_add(
                "DAY",
                ((micros - rest) / day).cast("int"),
                F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"),
            ),
        )
    return F.timestamp_micros(micros)
