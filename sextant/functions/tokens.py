"""Token estimate of chat texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.strings import _col

# four letters or digits, one other ASCII non-blank, or one non-ASCII character
TOKEN_UNIT = (
    r"[A-Za-z0-9]{1,4}|[\x00-\x08\x0E-\x1B\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|[^\x00-\x7F]"
)
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
MESSAGE_OVERHEAD = 8


def estimate_tokens(text) -> Column:
    """Estimated tokens; characters beyond the basic plane count twice, blank text is 0."""
    value = F.coalesce(_col(text), F.lit(""))
    units = F.regexp_count(value, F.lit(TOKEN_UNIT)) + F.regexp_count(value, F.lit(ASTRAL))
    return F.when(F.regexp_replace(value, r"[\s\x1c-\x1f]+", "") == "", F.lit(0)).otherwise(units)


def message_cost(role, content) -> Column:
    return estimate_tokens(role) + estimate_tokens(content) + MESSAGE_OVERHEAD
