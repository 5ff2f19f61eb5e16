"""Strict parsing of flat-file fields: a value that does not fit exactly is null, false or zero.

Text is expected without white space at its ends. Parsing a number and judging its range are separate
steps, so that a caller can hold the parsed number in a column and evaluate it once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.fixed_values import (
    EARLIEST_MODEL_YEAR,
    HIGHEST_MILEAGE,
    LATEST_MODEL_YEAR,
    VEHICLE_TYPE,
)


def whole_number(text: Column) -> Column:
    """Digits only, within 32 bits, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))


def signed_number(text: Column) -> Column:
    """Digits with an optional sign, within 32 bits, else null."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def model_year(number: Column) -> Column:
    return F.when(number.between(EARLIEST_MODEL_YEAR, LATEST_MODEL_YEAR), number)


def mileage(number: Column) -> Column:
    """Odometer reading; implausible values are dropped, never clamped."""
    return F.when(number.between(1, HIGHEST_MILEAGE), number)


def cylinders(number: Column) -> Column:
    return F.when(number > 0, number)


def casualties(number: Column) -> Column:
    """A signed count; anything unreadable or negative counts as zero."""
    return F.greatest(F.coalesce(number, F.lit(0)), F.lit(0))


def strict_date(text: Column) -> Column:
    """An existing day written as eight digits (year, month, day), else null; there is no year 0000.

    Rearranged for the plain date cast, which needs no formatter and no exception per bad value.
    """
    readable = text.rlike("^[0-9]{8}$") & ~text.startswith("0000")
    day = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(readable, day.try_cast("date"))


def is_word(text: Column, word: str) -> Column:
    """Whether the field is exactly this word, in any case."""
    return F.coalesce(F.upper(text) == word.upper(), F.lit(False))


def is_vehicle(text: Column) -> Column:
    return is_word(text, VEHICLE_TYPE)


def is_y(text: Column) -> Column:
    return is_word(text, "Y")


def is_yes(text: Column) -> Column:
    return is_word(text, "YES")
