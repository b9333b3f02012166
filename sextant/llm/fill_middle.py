"""Fill-in-middle texts: each batch is cut, dealt and joined by ``pyarrow.compute`` kernels.

A text is a list of lines. The lists of a batch are flattened; each line's parent and its
ordinal in it tell its role (prefix, middle or suffix). The lines of a role are filtered
out, rebuilt as lists and joined, and the pieces are put behind their marks. No kernel
looks at one row alone, and a batch is cut into runs of bounded bytes first, so a task
holds a few times that many bytes, or one text if that is longer.

Two draws of a document place its cuts, one chooses whether it is changed at all and one
the order: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle. All draws
come from the SHA-256 of a seed and the document's id, so a repeated task repeats them.

Cases: a null text is an empty one; an empty text, and one that contains a mark, stays as
it is (``plain``); a null id draws like an empty one; repeated rows give equal rows; an
empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Percent of the documents that are changed, and of these the share in suffix-first order.
RATE, SUFFIX_FIRST = 100, 50
SEED = "7"
#: Bytes of text that are worked on at once.
RUN_BYTES = 16 << 20


def draws(doc_id: Column, seed: str = SEED) -> Column:
    """Four unsigned 32-bit draws of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def runs(batch: pa.RecordBatch, column: str, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of at most so many bytes of text or of one row."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(int(np.searchsorted(total, before + most, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _concat(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*(_text(x) if isinstance(x, str) else x for x in parts), _text(""))


def _joined(units: pa.Array, parents: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """For each row, the kept units of it, joined in order."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[keep], minlength=rows))])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), units.filter(pa.array(keep)))
    return pc.binary_join(lists, _text(""))


def lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All lines with their line ends, flat; the row of each, its ordinal there, and the lines of each row."""
    pieces = pc.split_pattern(texts, "\n")
    flat = pc.list_flatten(pieces)
    parents = pc.list_parent_indices(pieces).to_numpy()
    sizes = pc.list_value_length(pieces).to_numpy().astype(np.int64)
    ordinals = np.arange(len(parents)) - (np.cumsum(sizes) - sizes)[parents]
    last = ordinals == sizes[parents] - 1
    units = _concat(flat, pc.if_else(pa.array(last), _text(""), _text("\n")))
    # what follows the last line end is a line only if it is not empty
    real = ~(last & (pc.binary_length(units).to_numpy() == 0))
    return units.filter(pa.array(real)), parents[real], ordinals[real], np.bincount(parents[real], minlength=len(texts))


def _form(texts: pa.Array, h: np.ndarray, rate: int, suffix_first: int) -> np.ndarray:
    marked = [pc.match_substring(texts, m).to_numpy(zero_copy_only=False) for m in MARKS]
    plain = np.logical_or.reduce([pc.binary_length(texts).to_numpy() == 0, *marked, h[:, 2] % 100 >= rate])
    return np.where(plain, "plain", np.where(h[:, 3] % 100 < suffix_first, "spm", "psm"))


def _empty(value: pa.Array) -> pa.Array:
    return pc.fill_null(value.cast(pa.large_string()), "")


def rearranged(batch: pa.RecordBatch, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> pa.RecordBatch:
    """``doc_id``, number of lines, form, characters of prefix and middle, and output of each row."""
    texts = _empty(batch.column("text"))
    rows = len(texts)
    h = batch.column("draws").flatten().to_numpy().reshape(rows, 4)
    units, parents, ordinals, n = lines(texts)
    cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    role = (ordinals >= cut[parents, 0]).astype(np.int8) + (ordinals >= cut[parents, 1])
    prefix, middle, suffix = (_joined(units, parents, role == k, rows) for k in range(3))
    form = _form(texts, h, rate, suffix_first)
    plain = pa.array(form == "plain")
    psm = _concat(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    spm = _concat(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    output = pc.if_else(plain, texts, pc.if_else(pa.array(form == "spm"), spm, psm))
    counts = [pc.if_else(plain, None, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), *counts, output.cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that outputs were made from; each mark stands once in a changed output."""
    output = _empty(output)
    rows = len(output)
    # the marks' places tell the pieces: split at all three, and take them by the form's order
    pieces = pc.split_pattern_regex(output, "<[PSM]>")
    kept = pa.array(pc.not_equal(form, "plain").to_numpy(zero_copy_only=False))
    parts = pc.list_flatten(pieces.filter(kept))
    at = np.arange(int(pc.sum(kept).as_py() or 0)) * 4
    spm = pc.equal(form.filter(kept), "spm").to_numpy(zero_copy_only=False)
    prefix, suffix = (parts.take(pa.array(at + np.where(spm == first, 1, 2))) for first in (False, True))
    whole = _concat(prefix, parts.take(pa.array(at + 3)), suffix)
    place = np.zeros(rows, np.int64)
    place[kept.to_numpy(zero_copy_only=False)] = np.arange(len(whole))
    spread = whole.take(pa.array(place)) if len(whole) else output
    return pc.if_else(kept, spread, output).cast(pa.string())


def rearrange(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``: every document in its form."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text"):
                yield rearranged(part, rate, suffix_first)

    read = docs.select("doc_id", "text", draws(F.col("doc_id"), seed).alias("draws"))
    return read.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """Put the text that it was made from, ``restored``, in the place of each ``output``."""
    others = [f for f in rows.schema.fields if f.name not in ("output", "restored")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "output"):
                columns = [part.column(f.name) for f in others]
                columns.append(rebuilt(part.column("output"), part.column("form")))
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in others), "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{schema}, restored string")


def digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query: the form and checksums of each document."""
    changed = rearrange(docs).withColumn("output_sha256", F.sha2("output", 256))
    return restore(changed).withColumn("restored_sha256", F.sha2("restored", 256)).drop("restored")
