"""Tabular sources to documents: frame cleaning, column names, one document per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions.strings import SPACE, clean_text, strip
from sextant.operators.ranking import running_sum

CELL_LIMIT = 2000


def normalize_columns(names: Sequence[str]) -> list[str]:
    """Blank and placeholder names become column_i; repeats get a number."""
    seen: dict[str, int] = {}
    out = []
    for position, raw in enumerate(names, start=1):
        name = str(raw).strip()
        if name.lower() in ("", "nan", "none", "unnamed: 0"):
            name = f"column_{position}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def _present(column: str, kind: T.DataType) -> Column:
    """The cell as text, null when it is null, blank or not finite."""
    value = F.col(f"`{column}`")
    text = value.cast("string")
    missing = text.rlike(rf"(?U)\A{SPACE}*\z")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~missing, text)


def clean_cell(value) -> Column:
    """Cleaned text of a cell cut to 2000 characters; a missing cell is empty."""
    return F.substring(clean_text(F.coalesce(value, F.lit(""))), 1, CELL_LIMIT)


def clean_table(frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop empty rows and empty columns, fix the names, clean the cells.

    ``keep`` names bookkeeping columns (source, position) left untouched. One
    aggregation finds the empty columns; its single row is all that reaches the driver.
    """
    cells = [f for f in frame.schema.fields if f.name not in keep]
    present = frame.select(*keep, *[_present(f.name, f.dataType).alias(f.name) for f in cells])
    quoted = [F.col(f"`{f.name}`") for f in cells]
    filled = present.filter(F.coalesce(*quoted).isNotNull())
    counts = filled.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(quoted)]).first()
    used = [f.name for i, f in enumerate(cells) if counts[i]]
    names = normalize_columns(used)
    cleaned = filled.select(
        *keep, *[clean_cell(F.col(f"`{old}`")).alias(new) for old, new in zip(used, names)]
    )
    if not names:
        return cleaned.filter(F.lit(False))
    return cleaned.filter(F.concat(*[F.col(f"`{n}`") for n in names]) != "")


def rows_to_documents(
    cleaned: DataFrame, source: str = "source", position: str = "position", sheet: str | None = None
) -> DataFrame:
    """One document per row: ``column: value`` lines of the non-empty cells.

    ``position`` is the integer order of the rows in their source; the row number counts
    the rows left after cleaning, per source, by a two-level running count.
    """
    keep = [c for c in (source, position, sheet) if c]
    names = [c for c in cleaned.columns if c not in keep]
    lines = F.array(
        *[
            F.when(strip(F.col(f"`{n}`")) != "", F.concat(F.lit(f"{n}: "), strip(F.col(f"`{n}`"))))
            for n in names
        ]
    )
    text = F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
    groups = [source] + ([sheet] if sheet else [])
    numbered = running_sum(
        cleaned.select(*keep, text.alias("text")).withColumn("__one", F.lit(1).cast("long")),
        groups, position, "__one", "row",
    )
    return numbered.select(*groups, position, "row", "text").filter("text <> ''")
