"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but ids of 16 bits, lowest byte first; each document ends with the
end id. A header of five ids below 2^15 may stand first in each document and holds its
number. Files are cut into blocks wherever they happen to fall. In each block one
vectorised search finds all end ids; documents that lie inside the block are counted at
once. What stands before its first and after its last end id are open pieces. A running
count of the blocks with an end id, a prefix scan over each file's blocks, numbers the
documents that cross borders; their pieces are summed by that number, and a header that a
border cuts is put together from the pieces' beginnings.

Cases: a null or empty text is a document of no tokens; ids after the last end id of a
file are a document if there are any; the names of special tokens are ordinary text when
files are written, so that the end id never stands inside a document; a null id keeps a
header of its own and stays null; repeated rows are documents of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import bpe, packing
from sextant.session import shared_dir, store

END = 50256
HEADER = 5
DIGIT = 15
#: Ids of a block, and rows (of a few hundred thousand ids) of a file.
BLOCK = 1 << 18
ROWS_PER_FILE = 32


def header(number: int | None) -> list[int]:
    """Five ids below 2^15; a null has the greatest of all, which no number has."""
    value = (1 << DIGIT * HEADER) - 1 if number is None else number % (1 << 64)
    return [value >> DIGIT * k & (1 << DIGIT) - 1 for k in range(HEADER)]


def number(ids: list[int]) -> int | None:
    value = sum(int(x) << DIGIT * k for k, x in enumerate(ids))
    if len(ids) < HEADER or value >= 1 << 64:
        return None
    return value - (1 << 64) if value >= 1 << 63 else value


def write(docs: DataFrame, tokenizer: str, path: str | None = None) -> str:
    """Write the documents as token files below a shared folder and give its name.

    Each row of the writer is a stretch of whole documents without its last byte, the high
    byte of the end id, which the writer sets behind each row.
    """
    path = path or shared_dir(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = packing.fast_vocabulary(tokenizer)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            parts, size = [], 0
            for row, ids in bpe.encoded(batch, vocab, special=False):
                parts += [np.array(header(ids_of[row]), "<u2"), ids.astype("<u2"), np.array([END], "<u2")]
                size += len(ids)
                if size >= BLOCK:
                    yield _row(parts)
                    parts, size = [], 0
            if parts:
                yield _row(parts)

    stretches = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "ids binary")
    writer = stretches.select(F.col("ids").cast("string").alias("value")).write
    last = bytes([END >> 8]).decode("latin-1")
    writer.options(encoding="ISO-8859-1", lineSep=last, compression="none", maxRecordsPerFile=ROWS_PER_FILE).text(path)
    return path


def _row(parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()[:-1]], pa.binary())], ["ids"])


def scan_block(ids: np.ndarray, first: int, has_header: bool) -> tuple[list, list, tuple]:
    """Numbers and counts of the whole documents inside, then the open pieces around them.

    The pieces are ``(ends, head length, head beginning, tail length, tail beginning)``.
    """
    ends = np.flatnonzero(ids == END)
    cut = HEADER if has_header else 0
    if not len(ends):
        return [], [], (0, len(ids), ids[:HEADER].tolist(), 0, [])
    starts, stops = ends[:-1] + 1, ends[1:]
    counts = (stops - starts - cut).tolist()
    numbers = [number(ids[a : a + HEADER].tolist()) if has_header else first + int(a) for a in starts]
    tail = ids[ends[-1] + 1 :]
    return numbers, counts, (1, int(ends[0]), ids[: min(HEADER, ends[0])].tolist(), len(tail), tail[:HEADER].tolist())


def scan(spark: SparkSession, path: str, has_header: bool = True, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens`` of each document; without headers the id is its first place in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                for k in range(-(-len(ids) // block)):
                    numbers, counts, around = scan_block(ids[k * block : (k + 1) * block], k * block, has_header)
                    n = len(numbers)
                    columns = [[name] * (n + 1), [k] * (n + 1), [*numbers, None], [*counts, None]]
                    columns += [[None] * n + [x] for x in (*around, min(len(ids), (k + 1) * block) - around[3])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["file", "block", "doc_id", "n_tokens", "ends", "head", "head_ids", "tail", "tail_ids", "tail_at"]
    few = pa.list_(pa.int32())
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), few, pa.int64(), few, pa.int64()]
    schema = (
        "file string, block long, doc_id long, n_tokens long, ends int, head long, head_ids array<int>, "
        "tail long, tail_ids array<int>, tail_at long"
    )
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = store(files.mapInArrow(run, schema), "token-blocks")
    inside = found.filter("ends IS NULL").select("doc_id", "n_tokens")
    return inside.union(_stitched(found.filter("ends IS NOT NULL"), has_header, block))


def _stitched(blocks: DataFrame, has_header: bool, block: int) -> DataFrame:
    """The documents that touch a border, from the open pieces of the blocks."""
    before = "coalesce(sum(ends) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    numbered = blocks.withColumn("document", F.expr(before))
    head = F.struct(
        F.col("document"), (2 * F.col("block")).alias("at"), F.col("head").alias("n"), F.col("head_ids").alias("ids"),
        (F.col("ends") > 0).alias("closed"), (F.col("block") * block).alias("place"),
    )
    tail = F.struct(
        (F.col("document") + 1).alias("document"), (2 * F.col("block") + 1).alias("at"), F.col("tail").alias("n"),
        F.col("tail_ids").alias("ids"), F.lit(False).alias("closed"), F.col("tail_at").alias("place"),
    )
    pieces = numbered.select("file", F.explode(F.when(F.col("ends") > 0, F.array(head, tail)).otherwise(F.array(head))).alias("p"))
    whole = pieces.groupBy("file", "p.document").agg(
        F.sum("p.n").alias("n"),
        F.max("p.closed").alias("closed"),
        F.min("p.place").alias("place"),
        F.sort_array(F.collect_list(F.when(F.size("p.ids") > 0, F.struct("p.at", "p.ids")))).alias("beginnings"),
    )
    digits = F.slice(F.flatten(F.transform("beginnings", lambda b: b["ids"])), 1, HEADER)
    value = F.aggregate(
        F.reverse(digits),
        F.lit(0).cast("decimal(38,0)"),
        lambda s, d: (s * F.lit(1 << DIGIT).cast("decimal(6,0)") + d.cast("decimal(6,0)")).cast("decimal(38,0)"),
    )
    top = F.expr("9223372036854775808BD")
    signed = F.when(value >= 2 * top, None).when(value >= top, value - 2 * top).otherwise(value).cast("long")
    doc_id = F.when(F.size(digits) == HEADER, signed) if has_header else F.col("place")
    cut = HEADER if has_header else 0
    return whole.filter("closed OR n > 0").select(doc_id.alias("doc_id"), (F.col("n") - cut).alias("n_tokens"))
