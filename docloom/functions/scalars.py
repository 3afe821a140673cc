"""Small scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: digits of a log position in its external form.
POSITION_DIGITS = 30


def format_position(seq: Column) -> Column:
    return F.lpad(seq.cast("string"), POSITION_DIGITS, "0")


def parse_position(text: Column) -> Column:
    return text.cast("bigint")


def field_path(*parts: Column) -> Column:
    return F.concat_ws("$", *parts)


def read_float(text: Column) -> Column:
    return F.trim(text).try_cast("float")


def read_int(text: Column) -> Column:
    """Parsed as a float and cut off, so that ``12.0`` is 12."""
    return read_float(text).cast("int")
