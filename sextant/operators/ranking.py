"""Shared ranking helpers that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit, rank: str | None = None, bound: int | None = None
) -> DataFrame:
    """First ``limit`` rows of each group (a number or a column; all rows if none).

    A constant becomes a pre-shuffle group limit in the plan, so each task sends at most
    that many rows of a group to the ranking task. With a limit column, ``bound`` is the
    largest value that column can hold and serves as that constant; rows past the
    column's own limit are dropped by the exact test.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    if limit is None:
        return ranked if rank else df
    kept = ranked.filter(F.col(name) <= limit)
    if bound is not None:
        kept = ranked.filter((F.col(name) <= F.lit(bound)) & (F.col(name) <= limit))
    return kept if rank else kept.drop(name)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; partial aggregation keeps one row per key and task.

    ``order`` gives ascending sort keys (negate numbers to sort them downwards).
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(packed.alias("__best")).select(*keys, "__best.*")


def min_max_normalize(df: DataFrame, keys: Sequence[str], score: str, out: str) -> DataFrame:
    """Min-max of a score inside each group; a group of equal scores gets 1.0.

    The extremes are a partial aggregate joined back, so a group of any size is never
    brought together.
    """
    bounds = df.groupBy(*keys).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    value = F.when(F.col("__hi") == F.col("__lo"), F.lit(1.0)).otherwise(
        (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    )
    return df.join(bounds, list(keys)).withColumn(out, value).drop("__lo", "__hi")


def min_max_over(score: Column, keys: Sequence[str]) -> Column:
    """Window form for groups that an earlier top-k has already bounded."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / (hi - lo))


def running_sum(
    df: DataFrame, keys: Sequence[str], position: str, value: str, out: str, block: int = 4096, descending: bool = False
) -> DataFrame:
    """Inclusive running sum along an integer position, in two levels.

    Rows are grouped into blocks of ``block`` positions. Block totals are summed first,
    then each block is summed on its own and shifted by the total before it: a group
    holding a third of all rows is spread over its blocks.
    """
    tagged = df.withColumn("__block", F.floor(F.col(position) / block).cast("long"))
    direction = F.col("__block").desc() if descending else F.col("__block").asc()
    totals = tagged.groupBy(*keys, "__block").agg(F.sum(value).alias("__total"))
    before = W.partitionBy(*keys).orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset")
    )
    inside = W.partitionBy(*keys, "__block").orderBy(
        F.col(position).desc() if descending else F.col(position).asc()
    ).rowsBetween(W.unboundedPreceding, 0)
    return (
        tagged.join(offsets, [*keys, "__block"])
        .withColumn(out, F.col("__offset") + F.sum(value).over(inside))
        .drop("__block", "__offset")
    )
