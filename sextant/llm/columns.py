"""Column helpers for long native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name for use in ``body``, so that it is computed once.

    A column used inside a lambda would otherwise be computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower case as far as ASCII words are concerned.

    The Kelvin sign is the one other character whose lower case is a plain ASCII letter;
    it is made another letter first. All other letters stay outside ASCII either way.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("ķ")))


def words(text: Column, breaks: str) -> Column:
    """The non-empty pieces between runs of the given character class."""
    return F.filter(F.split(text, breaks), lambda w: w != "")


def literals(values) -> Column:
    """An array of string literals, typed also when there are none."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
