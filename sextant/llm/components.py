"""Connected components of a graph that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import store

#: Rounds halve the longest chain at least; 64 is far beyond any graph that can be stored.
ROUNDS = 64


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Give every node of the edges its component's smallest node: ``(node, component)``.

    Rounds of two steps, each a grouped minimum and a join back: every larger neighbour of
    a node is linked to the node's smallest neighbour, then every smaller one. A hot node
    is pre-aggregated in the minimum and split by the skew join. Each round is written to
    the shared folder. The graph is done when a round leaves it as it was: all stars.
    Loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    pairs = store(
        edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .filter("_a IS NOT NULL AND _b IS NOT NULL AND low < high")
        .select("low", "high")
        .distinct(),
        "components",
    )
    before = _state(pairs)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        pairs = store(_small_star(_large_star(pairs)).distinct(), "components")
        after = _state(pairs)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        pairs.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("low").alias("u"), F.col("high").alias("v")).union(
        pairs.select(F.col("high").alias("u"), F.col("low").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("high").agg(F.min("low").alias("m"))
    lower = pairs.join(least, "high").filter("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))
    return lower.union(least.select(F.col("m").alias("low"), "high"))
