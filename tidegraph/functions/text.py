"""Text helpers for command lines, labels and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and columns read instead of repeating
    its expression, as filters pushed below a plain column would."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def normalised(line: Column) -> Column:
    """A line without leading and trailing blanks, tabs and line ends."""
    return F.btrim(line, F.lit(" \t\r\n"))


def safe_label(text: Column) -> Column:
    """Free text as one token: spaces become ``_``, line ends vanish."""
    return F.translate(text, " \n\r", "_")


def command_text(
    op: str | Column = "op",
    src: str | Column = "src",
    attr: str | Column = "attr",
    dst: str | Column = "dst",
) -> Column:
    """The text line of a command; node commands have no label and target."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat_ws(
        " ", col(op), col(src).cast("string"), col(attr), col(dst).cast("string")
    )


def words(text: Column) -> Column:
    """The whitespace-separated words of a text, with empty ones at its ends."""
    return F.split(text, r"[ \t\n\r\f]+")
