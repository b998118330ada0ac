"""Small column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of characters other than space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def words(text: Column) -> Column:
    """The words of a text; none for a null or blank one."""
    return let(
        trimmed(F.coalesce(text, F.lit(""))),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)),
    )


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
