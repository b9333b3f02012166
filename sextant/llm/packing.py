"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids, closed by an end id, are cut into whole windows, which are sequences of
their own, and a rest, cut into fragments of at most ``FRAGMENT`` ids. Fragments are dealt
at random into groups of about ``WINDOWS`` windows, a bounded amount of work each. In a
group every fragment starts as a partial partition of its own; the two with the largest
spread are merged again and again, the largest window of one with the smallest of the
other, until one partition is left, whose windows are nearly equal. If its fullest window
is over the capacity, there is one window more and the differencing starts again.

Cases: a null or empty text is one piece, the end id alone; repeated rows are packed as
often as they occur; ties are broken by the order of the pieces; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import bpe
from sextant.session import store

CAPACITY = 1024
FRAGMENT = 128
WINDOWS = 128
END = 0


class FastVocabulary(bpe.Vocabulary):
    """The same ids, with short pieces encoded by a compiled library."""

    def __init__(self, path: str):
        super().__init__(path)
        ranks = {self.tokens[i].encode("latin-1"): i for i in range(self.size) if i not in self.special.values()}
        self.library = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if any(len(p) > 256 for p in pieces):
            return super().encode_new(pieces)  # linear time, however long
        found = list(map(self.library.encode_single_piece, pieces))
        counts = np.array(list(map(len, found)), np.int64)
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


@lru_cache(2)
def fast_vocabulary(path: str) -> FastVocabulary:
    return FastVocabulary(path)


def cut_points(n: int, capacity: int, fragment: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the whole windows, then of the fragments, of n ids."""
    whole = n - n % capacity
    rest = [(a, min(fragment, n - a)) for a in range(whole, n, fragment)]
    return [(a, capacity) for a in range(0, whole, capacity)] + rest


def pieces(docs: DataFrame, path: str, capacity: int, fragment: int, with_ids: bool) -> DataFrame:
    """One row per piece of each document, with the ids themselves if asked for."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = fast_vocabulary(path)
        for batch in batches:
            rows, starts, lengths, sums, totals, values = [], [], [], [], [], []
            for row, found in bpe.encoded(batch, vocab):
                ids = np.append(found, END).astype("<u4")
                for a, n in cut_points(len(ids), capacity, fragment):
                    part = ids[a : a + n]
                    rows.append(row)
                    starts.append(a)
                    lengths.append(n)
                    sums.append(zlib.crc32(part))
                    totals.append(len(ids))
                    if with_ids:
                        values.append(part.astype(np.int32))
                    if len(rows) >= 20_000:
                        yield _pieces(batch, rows, starts, lengths, sums, totals, values, with_ids)
                        rows, starts, lengths, sums, totals, values = [], [], [], [], [], []
            if rows:
                yield _pieces(batch, rows, starts, lengths, sums, totals, values, with_ids)

    schema = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pieces(batch, rows, starts, lengths, sums, totals, values, with_ids) -> pa.RecordBatch:
    columns = {"doc_id": batch.column("doc_id").take(pa.array(rows))}
    columns |= {k: pa.array(v, pa.int64()) for k, v in zip(("start", "length", "ids_crc32", "doc_tokens"), (starts, lengths, sums, totals))}
    if with_ids:
        columns["ids"] = pa.array(values, pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each piece after multiway differencing into so many windows."""
    n = len(sizes)
    # a partial partition: its windows' sums, largest first, and their nodes (-1: empty);
    # a node is a piece, or a merger of two nodes
    merged: list[tuple[np.ndarray, np.ndarray]] = []
    count = n
    heap = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        heap.append((-int(sizes[k]) if windows > 1 else 0, len(heap), sizes[k : k + 1], np.array([k])))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:
            # the smallest of one meet the largest of the other
            tail = slice(len(a) - over, len(a))
            left, right = a_nodes[tail], b_nodes[:over][::-1]
            fresh = np.arange(count, count + over)
            merged.append((left, right))
            count += over
            sums = np.concatenate([a[: len(a) - over], a[tail] + b[:over][::-1], b[over:]])
            nodes = np.concatenate([a_nodes[: len(a) - over], fresh, b_nodes[over:]])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-int(spread), order, sums, nodes))
        order += 1
    window = np.zeros(count, np.int64)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    for left, right in reversed(merged):
        count -= len(left)
        window[left] = window[right] = window[count : count + len(left)]
    return window[:n]


def near_equal_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each piece, in the fewest windows whose differencing keeps the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if np.bincount(window, sizes).max() <= capacity:
            return window
        windows += 1


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, fragment: int = FRAGMENT, windows: int = WINDOWS, with_ids: bool = False
) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset`` there."""
    if not 0 < fragment <= capacity:
        raise ValueError("a fragment must fit into a window")
    cut = pieces(docs, path, capacity, fragment, with_ids).withColumn("piece_id", F.monotonically_increasing_id())
    every = store(cut, "pieces")
    whole = every.filter(F.col("length") == capacity).select(
        *[c for c in every.columns if c != "piece_id"],
        (F.lit(1 << 62) + F.col("piece_id")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = every.filter(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * windows)))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_id")
        sizes = table.column("length").to_numpy()
        window = near_equal_windows(sizes, capacity)
        by = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[by])
        first = np.r_[True, window[by][1:] != window[by][:-1]]
        starts = ends - sizes[by]
        offset = np.empty(len(sizes), np.int64)
        offset[by] = starts - np.maximum.accumulate(np.where(first, starts, 0))
        sequence = table.column("group")[0].as_py() * (1 << 24) + window
        out = table.drop_columns(["piece_id", "group"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("group").applyInArrow(run, whole.schema)
    return whole.union(packed)
