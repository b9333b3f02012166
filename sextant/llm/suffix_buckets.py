"""Removal of repeated byte strings by bucket-pointer refinement.

A place in a text belongs to a bucket: the identifier of the bytes that start there. The
identifier for twice the depth is made from those at the place and one depth later, so
each step reuses the ones before. Buckets are refined only while they hold several places.

The strings have ``DEPTH`` bytes unless another depth is given.

1. *Initial buckets.* Of the 369 32-byte grams inside a 400-byte string, the one with the
   least identifier (the leftmost of equals) is its anchor: equal strings have equal
   anchors at equal places. Neighbouring strings share an anchor and form a run, about one
   for each 185 bytes. A string that occurs twice lies in two runs of one bucket.
2. *Whole runs.* Runs with the same bytes from the first string's start to the last one's
   end are copies: all their strings repeat. Each such class goes on as one representative.
3. *Groups.* In buckets with several classes, strings are taken 64 at a time by their
   distance from the anchor; they share a core of 337 bytes, whose identifier is their new
   bucket, and carry the bytes around it. A bucket of one group is dropped. Groups whose
   bytes are all the same are copies, and one goes on; if their bucket has nothing else,
   none does. What goes on is cut into groups of 16, then 4, then single strings, where the
   core is the whole string: each level finds its identifiers from the core and the bytes
   carried along, without the texts.

Hot buckets are counted by partial aggregation and met again in joins that can be split;
no bucket is ever gathered. Texts meet their ranges in a join by document.

Cases: a null text is empty; texts shorter than a string keep all bytes; repeated rows are
copies of each other; strings repeat across and inside documents, overlapping or not; an
empty table gives no rows; other columns are kept by ``remove_repeats`` and not read
otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.session import store

DEPTH = 400
GRAM = 32
STEPS = (64, 16, 4, 1)  # strings in a group, level by level
#: Bytes worked on at a time; places must fit into PLACE_BITS. A longer text is cut into
#: pieces that overlap by one byte less than a string.
CHUNK = 1 << 20
PLACE_BITS = 21
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def identifiers(data: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of the ``depth`` bytes, a power of two, from each place on."""
    a, b = (np.uint64(m) for m in MULTIPLIERS)
    ids = (data.astype(np.uint64) + np.uint64(1)) * a
    have = 1
    while have < depth:
        out = ids[: len(ids) - have] * a
        out ^= out >> np.uint64(32)
        out += ids[have:]
        out *= b
        out ^= out >> np.uint64(29)
        ids, have = out, 2 * have
    return ids


def sliding_least(values: np.ndarray, window: int) -> np.ndarray:
    """Least value of each run of ``window`` values."""
    n = len(values) - window + 1
    blocks = -(-len(values) // window)
    padded = np.full(blocks * window, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])


def pieces(column: pa.Array, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(data, rows, begins, firsts)``: texts as bytes laid end to end, up to ``CHUNK`` long.

    A piece of row ``rows[k]`` begins at ``begins[k]`` and, within its text, at ``firsts[k]``.
    """
    parts, rows, begins, firsts, size = [], [], [], [], 0
    for row, text in enumerate(column):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        first = 0
        while len(data) - first >= depth:
            part = data[first : first + CHUNK]
            if size and size + len(part) > CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(begins), np.array(firsts)
                parts, rows, begins, firsts, size = [], [], [], [], 0
            parts.append(part)
            rows.append(row)
            begins.append(size)
            firsts.append(first)
            size += len(part)
            first += len(part) - depth + 1
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(begins), np.array(firsts)


def find_runs(data: np.ndarray, begins: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first place, length, place of the anchor, its gram."""
    grams = identifiers(data, GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(ranked, depth - GRAM + 1) & low).astype(np.int64)
    ends = np.r_[begins[1:], len(data)]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends - depth + 1] -= 1
    inside = np.cumsum(inside[: len(anchor)]).astype(bool)
    fresh = inside.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(fresh)
    stop = inside.copy()
    stop[:-1] &= fresh[1:] | ~inside[1:]
    length = np.flatnonzero(stop) - start + 1
    return start, length, anchor[start], grams[anchor[start]]


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    """A document's key: its id with a hash of its text, so that repeated ids are told apart."""
    return docs.select(F.col("doc_id").alias("d"), _text_hash().alias("h"), "text")


def _key_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def runs(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """All runs: ``first`` place, ``n`` strings, ``off`` from there to the anchor, bucket and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, rows, begins, firsts in pieces(batch.column("text"), depth):
                start, n, anchor, gram = find_runs(data, begins, depth)
                view = memoryview(data)
                content = [xxhash.xxh3_64_intdigest(view[a : a + k + depth - 1]) for a, k in zip(start.tolist(), n.tolist())]
                piece = np.searchsorted(begins, start, "right") - 1
                which = pa.array(rows[piece])
                columns = {
                    "d": batch.column("d").take(which),
                    "h": batch.column("h").take(which),
                    "first": pa.array(start - begins[piece] + firsts[piece]),
                    "n": pa.array(n.astype(np.int32)),
                    "off": pa.array((anchor - start).astype(np.int32)),
                    "gram": pa.array(gram.view(np.int64)),
                    "content": pa.array(np.array(content, np.uint64).view(np.int64)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"d {_key_type(docs)}, h long, first long, n int, off int, gram long, content long"
    return _texts(docs).mapInArrow(run, schema)


GROUP = "core binary, whole binary, before binary, after binary, near int, d {0}, h long, first long, last long"


def _group(core: bytes, before: bytes, after: bytes, near: int) -> tuple[bytes, bytes, bytes, bytes, int]:
    """A group: identifiers of its core and of all its bytes, the bytes around the core.

    ``near`` is the distance from its last string's start to its core.
    """
    around = b"%d:%d:" % (near, len(before)) + before + after
    return core, xxhash.xxh3_128_digest(core + around), before, after, near


def groups_of_runs(docs: DataFrame, wanted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Groups of the first level for the wanted runs: ``(d, h, runs: array<first, n, off>)``."""
    step = STEPS[0]
    schema = GROUP.format(_key_type(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = row["text"].encode("utf-8", "surrogatepass")
                for r in row["runs"]:
                    first, last, anchor = r["first"], r["first"] + r["n"] - 1, r["first"] + r["off"]
                    for j in range((anchor - last) // step, (anchor - first) // step + 1):
                        low = anchor - step * j
                        a, b = max(first, low - step + 1), min(last, low)
                        high = low - step + 1 + depth
                        core = xxhash.xxh3_128_digest(data[low:high])
                        group = _group(core, data[a:low], data[high : b + depth], low - b)
                        out.append((*group, row["d"], row["h"], a, b))
                    if len(out) > 20_000:
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)

    met = _join(wanted, _texts(docs).filter(F.length("text") > 0), "inner")
    return met.select("d", "h", "text", "runs").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"core": pa.binary(), "whole": pa.binary(), "before": pa.binary(), "after": pa.binary(), "near": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k)) for k, c in zip(names, zip(*rows))], names)


def split_groups(groups: DataFrame, step: int, finer: int) -> DataFrame:
    """Cut groups of up to ``step`` strings into groups of up to ``finer``."""
    kind = groups.schema["d"].dataType.simpleString()
    schema = GROUP.format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                before, after, near, first, last = row["before"], row["after"], row["near"], row["first"], row["last"]
                # a string's distance to the core runs from near to near + last - first, below step
                for j in range(near // finer, (near + last - first) // finer + 1):
                    close, far = max(near, j * finer), min(near + last - first, (j + 1) * finer - 1)
                    # the new core grows by what all strings of distances j * finer .. + finer - 1 hold
                    left, right = j * finer, step - 1 - ((j + 1) * finer - 1)
                    core = xxhash.xxh3_128_digest(row["core"] + before[len(before) - left :] + after[:right] + b"%d" % j)
                    rest = before[len(before) - far : len(before) - left]
                    group = _group(core, rest, after[right : step - 1 - close], close - left)
                    out.append((*group, row["d"], row["h"], first + near + last - first - far, first + near + last - first - close))
                if len(out) > 20_000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    return groups.mapInArrow(run, schema)


def _join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"d": "_d", "h": "_h"})
    on = F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    return left.join(right, on, how).drop("_d", "_h")


def repeated_starts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(d, h, first, stop)``: places, from first to before stop, where repeated strings start."""
    every = store(runs(docs, depth), "runs")
    classes = store(
        every.groupBy("gram", "content").agg(F.count("*").alias("copies"), F.min(F.struct("d", "h", "first", "n", "off")).alias("run")),
        "run-classes",
    )
    copies = classes.filter("copies > 1").select("gram", "content")
    found = [every.join(copies, ["gram", "content"]).select("d", "h", "first", (F.col("first") + F.col("n")).alias("stop"))]
    # buckets with several classes go on
    several = classes.groupBy("gram").agg(F.count("*").alias("n_classes")).filter("n_classes > 1").select("gram")
    wanted = (
        classes.join(several, "gram")
        .select("run.*")
        .groupBy("d", "h")
        .agg(F.collect_list(F.struct("first", "n", "off")).alias("runs"))
    )
    groups = store(groups_of_runs(docs, wanted, depth), "groups")
    for step, finer in zip(STEPS, (*STEPS[1:], 0)):
        alike = store(
            groups.groupBy("core", "whole").agg(
                F.count("*").alias("copies"), F.min(F.struct("before", "after", "near", "d", "h", "first", "last")).alias("group")
            ),
            "group-classes",
        )
        repeated = alike.filter("copies > 1").select("core", "whole")
        found.append(groups.join(repeated, ["core", "whole"]).select("d", "h", "first", (F.col("last") + 1).alias("stop")))
        if finer:
            mixed = alike.groupBy("core").agg(F.count("*").alias("n_classes")).filter("n_classes > 1").select("core")
            groups = store(split_groups(alike.join(mixed, "core").select("core", "group.*"), step, finer), "groups")
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def cut(text: str | None, ranges: list[dict] | None, depth: int = DEPTH) -> tuple[bytes, int, int, int]:
    """Bytes left of a text, how many it had, how many went, and in how many runs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not ranges:
        return data, len(data), 0, 0
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for first, stop in sorted((r["first"], r["stop"]) for r in ranges):
        stop += depth - 1
        if first > end:
            spans += 1
            kept.append(data[at:first])
        removed += max(0, stop - max(first, at))
        end = at = max(at, stop)
    kept.append(data[at:])
    return b"".join(kept), len(data), removed, spans


def _with_ranges(docs: DataFrame, columns: list[str], depth: int = DEPTH) -> DataFrame:
    """``(row, ranges)``: the given columns as one struct, so that no names can clash."""
    ranges = repeated_starts(docs, depth).groupBy("d", "h").agg(F.collect_list(F.struct("first", "stop")).alias("ranges"))
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("d"), _text_hash().alias("h"))
    return _join(keyed, ranges, "left").select("row", "ranges")


def digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query: sizes, checksum and ``text``, what is left of each one.

    Characters that were cut apart are in the checksum, but not in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, sums, rest = [], [], [], [], []
            ids, texts = batch.column("row").flatten()
            for text, ranges in zip(texts, batch.column("ranges")):
                left, size, removed, count = cut(text.as_py(), ranges.as_py())
                n.append(size)
                gone.append(removed)
                spans.append(count)
                sums.append(hashlib.sha256(left).hexdigest())
                rest.append(left.decode("utf-8", "ignore"))
            columns = [ids, *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sums, pa.string()), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    schema = f"doc_id {_key_type(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    return _with_ranges(docs, ["doc_id", "text"]).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The documents without their repeated strings of ``depth`` bytes; characters that were cut apart go too.

    The depth must leave room for a gram in a group's core: at least ``STEPS[0] + GRAM`` bytes.

    All rows and other columns stay; a text that repeats as a whole becomes empty, a null
    text stays null.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            at = names.index("text")
            texts = []
            for text, ranges in zip(columns[at], batch.column("ranges")):
                value = text.as_py()
                texts.append(cut(value, ranges.as_py(), depth)[0].decode("utf-8", "ignore") if ranges.is_valid else value)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_ranges(docs, names, depth).mapInArrow(run, docs.schema)
