"""Embedding near-duplicates by a pigeonhole join over subspaces.

Two unit vectors of cosine c are ``2 - 2c`` apart in squared distance. A rotation spreads
that distance over all dimensions, which are cut into blocks; each block gets a share of
the budget in proportion to its dimensions. A pair within the whole budget is within its
share in one block at least. Each block is a range join: its leading coordinates make a
grid cell, a vector is at home in one cell and visits the cells that its range touches.
The vectors that meet are verified by their cosine in double precision. A pair counts
only in the first block that brings it together, so the union needs no second pass.

Equal vectors are one node with a weight. Cells of many residents are dealt over several
tasks, and visitors go to each. What leaves a task are counts and a spanning forest of its
links, not its pairs.

Cases: vectors that are null, zero, or hold nulls or values that are not finite, and
vectors of a null label or of another length than most, link with nothing; ties do not
matter; repeated rows are equal vectors; a null id counts as a vector but never names a
component, which is null if no id is left; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.components import components
from sextant.session import store

COSINE = 0.98
BLOCKS = 4
#: Residents of a cell in one task, and residents that the grid's fineness aims at.
RESIDENTS = 2048
AIM = 1024
#: Cell width over the range of a block.
WIDTH = 3.0
SEED = 7
#: Allowance for rounding, so that no pair falls between shares of the budget.
SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int)


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles of length one; ``(rows, norms)``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    raw = flat.reshape(len(column), -1)
    norms = np.sqrt((raw * raw).sum(axis=1))
    return raw / norms[:, None], norms


def _fine(vector: str, label: str) -> Column:
    """Whether a row can link at all; never null."""
    x = F.col(vector)
    size = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.col(label).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(size > 0, F.lit(False))


def visits(nodes: DataFrame, dims: int, cosine: float, blocks: int, axes: dict) -> DataFrame:
    """``(label, block, cell, home, node, weight, vector)`` for each node's cells.

    ``axes`` gives the number of leading coordinates that make the cells of a label.
    """
    edges = block_edges(dims, blocks)
    kind, values = (nodes.schema[c].dataType.simpleString() for c in ("label", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            z = units(batch.column("vector"))[0] @ turn
            used = np.array([axes.get(x, 1) for x in batch.column("label").to_pylist()])
            for b in range(len(edges) - 1):
                reach = np.sqrt((2 - 2 * cosine) * (edges[b + 1] - edges[b]) / dims + 2 * SLACK) + SLACK
                width = WIDTH * reach
                for k in np.unique(used):
                    k_axes = int(min(k, edges[b + 1] - edges[b]))
                    mine = np.flatnonzero(used == k)
                    x = z[mine, edges[b] : edges[b] + k_axes]
                    low = np.floor((x - reach) / width).astype(np.int64)
                    high = np.floor((x + reach) / width).astype(np.int64)
                    home = np.floor(x / width).astype(np.int64)
                    cells, whose, resident = [home], [mine], [np.ones(len(mine), bool)]
                    for corner in range(1 << k_axes):
                        up = np.array([corner >> a & 1 for a in range(k_axes)], bool)
                        real = np.all((high > low) | ~up, axis=1)  # each touched cell once
                        cells.append(np.where(up, high, low)[real])
                        whose.append(mine[real])
                        resident.append(np.zeros(real.sum(), bool))
                    at = np.concatenate(whose)
                    taken = batch.take(pa.array(at))
                    cell = np.concatenate(cells)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "label": taken.column("label"),
                            "block": pa.array(np.full(len(at), b, np.int32)),
                            "cell": pa.FixedSizeListArray.from_arrays(pa.array(cell.ravel()), k_axes).cast(pa.list_(pa.int64())),
                            "home": pa.array(np.concatenate(resident)),
                            "node": taken.column("node"),
                            "weight": taken.column("weight"),
                            "vector": taken.column("vector"),
                        }
                    )

    schema = f"label {kind}, block int, cell array<long>, home boolean, node long, weight long, vector {values}"
    return nodes.select("label", "node", "weight", "vector").mapInArrow(run, schema)


def _meet(dims: int, cosine: float, blocks: int):
    edges = block_edges(dims, blocks)
    budgets = (2 - 2 * cosine) * np.diff(edges) / dims + SLACK

    def run(table: pa.Table) -> pa.Table:
        turn = rotation(dims)
        block = table.column("block")[0].as_py()
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        node = table.column("node").to_numpy()
        weight = table.column("weight").to_numpy()
        x, _ = units(table.column("vector").combine_chunks())
        a, b = np.flatnonzero(~home), np.flatnonzero(home)
        counts = {}
        lows, highs = [], []
        z = np.einsum("ij,jk->ik", x, turn)
        for at in range(0, len(a), 512):
            some = a[at : at + 512]
            for bt in range(0, len(b), RESIDENTS):
                others = b[bt : bt + RESIDENTS]
                i, j = np.nonzero(x[some] @ x[others].T >= cosine - SLACK)
                i, j = some[i], others[j]
                ok = node[i] != node[j]
                i, j = i[ok], j[ok]
                # einsum sums each row alike in every task, so both ends judge alike
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                parts = np.add.reduceat((z[i] - z[j]) ** 2, edges[:-1], axis=1)
                first = (parts <= budgets).argmax(axis=1)
                mine = (first == block) & (parts[np.arange(len(i)), block] <= budgets[block])
                i, j = i[mine], j[mine]
                for k, w in zip(*_sums(node[i], weight[j])):
                    counts[k] = counts.get(k, 0) + w
                low, high = _forest(node[i], node[j])
                lows.append(low)
                highs.append(high)
        low, high = _forest(np.concatenate(lows), np.concatenate(highs)) if lows else (np.zeros(0, np.int64),) * 2
        n = len(counts)
        return pa.table(
            {
                "node": pa.array(np.r_[np.array(list(counts), np.int64), high]),
                "links": pa.array(np.r_[np.array(list(counts.values()), np.int64), np.zeros(len(high), np.int64)]),
                "low": pa.array(np.r_[np.full(n, -1, np.int64), low], mask=np.r_[np.ones(n, bool), np.zeros(len(low), bool)]),
            }
        )

    return run


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
    unique, back = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(unique), np.int64)
    np.add.at(sums, back, values)
    return unique.tolist(), sums.tolist()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the least node of its component among these links."""
    nodes, back = np.unique(np.r_[a, b], return_inverse=True)
    u, v = back[: len(a)], back[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        m = np.minimum(least[u], least[v])
        np.minimum.at(least, u, m)
        np.minimum.at(least, v, m)
        least = least[least]
        if np.array_equal(before, least):
            break
    linked = least != np.arange(len(nodes))
    return nodes[least[linked]], nodes[linked]


def near_duplicates(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, blocks: int = BLOCKS
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row."""
    good = rows.filter(_fine(vector, label)).select(
        F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    )
    lengths = [r["dims"] for r in good.select(F.size("vector").alias("dims")).distinct().orderBy("dims").collect()]
    found = rows.filter(~_fine(vector, label)).select(
        F.col(id).alias("id"), F.lit(0).cast("long").alias("n"), F.col(id).alias("component")
    )
    for dims in lengths:
        found = found.union(_of_length(good.filter(F.size("vector") == dims), dims, cosine, min(blocks, dims)))
    return _result(found, id)


def _of_length(good: DataFrame, dims: int, cosine: float, blocks: int) -> DataFrame:
    """``(id, n, component)`` for vectors that all have ``dims`` components."""
    nodes = store(
        good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    # the more vectors a label has, the more coordinates make its cells; any number is exact
    sizes = nodes.groupBy("label").count().orderBy(F.desc("count")).limit(1000).collect()
    axes = {r["label"]: int(np.clip(np.ceil(np.log2(max(r["count"] / AIM, 1))), 1, 8)) for r in sizes}
    seen = visits(nodes, dims, cosine, blocks, axes)
    cell = ["label", "block", "cell"]
    dealt = seen.groupBy(*cell).agg(F.ceil(F.count("*") / RESIDENTS).cast("int").alias("parts"))
    own, every = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), F.sequence(F.lit(0), F.col("parts") - 1)
    # each part of the residents meets each part of the visitors in one task
    parts = (
        seen.join(dealt, cell)
        .withColumn("residents", F.explode(F.when(F.col("home"), own).otherwise(every)))
        .withColumn("visitors", F.explode(F.when(F.col("home"), every).otherwise(own)))
    )
    met = store(
        parts.groupBy(*cell, "residents", "visitors").applyInArrow(_meet(dims, cosine, blocks), "node long, links long, low long"), "vector-links"
    )
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(met.filter("low IS NOT NULL"), "low", "node")
    named = (
        nodes.select("node", "label", "vector", "id", "weight")
        .join(links, "node", "left")
        .join(grouped, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    ids = named.join(least, "component").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), "least",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"),
    )
    return good.join(ids, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector"))).select(
        "id", "n", F.col("least").alias("component")
    )


def _result(rows: DataFrame, id: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(id),
        F.col("n").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
