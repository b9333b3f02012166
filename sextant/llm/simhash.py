"""SimHash near-duplicates, joined on fuzzy keys from a Golay code.

A 64-bit fingerprint is four segments of 16 bits. Two fingerprints that differ in at most
three bits have, among the four ordered pairs (segment i, the next segment), one whose
first segment is equal and whose second differs in at most one bit: at least one segment
is equal; if just one is, the others differ in one bit each; if two or three are, at most
one segment has more than one bit, and it follows only one of the equal ones.

The second segment, padded to 23 bits, is decoded to the nearest word of the perfect
(23, 12) Golay code; a word's index is its key. Decoding the segment and all its one-bit
neighbours gives a few indices, one of which is the index of any segment one bit away. So
each fingerprint has four home keys and about two dozen probe keys of 28 bits; equal keys
are joined, and the joined fingerprints compared bit by bit. Copies share a fingerprint
and are one node: groups of copies are never paired.

Cases: a null or blank text has the fingerprint zero, linked like any other; texts of
fewer words than a shingle are one shingle; repeated rows give equal rows; a null id has
no say in a component's smallest id; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.components import components
from sextant.session import store

SHINGLE = 3
SEED = 42
DISTANCE = 3
BITS = 16
SEGMENTS = 4
#: Shingles hashed at a time, so that a very long text needs no more memory than a short one.
CHUNK = 100_000
#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = words[at : min(at + CHUNK, n) + size - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(some[k:] for k in range(size)))]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, fp being the fingerprint as a signed long."""
    key = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key.simpleString()}, fp long")


def golay_index(vectors: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the code word nearest to each 23-bit vector."""
    vectors = vectors.astype(np.int64)
    patterns = [0, *(1 << a for a in range(23))]
    patterns += [1 << a | 1 << b for a in range(23) for b in range(a)]
    patterns += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
    errors = np.array(patterns, np.int64)
    table = np.empty(2048, np.int64)  # the code is perfect: each remainder has one such error
    table[_remainder(errors)] = errors
    return (vectors ^ table[_remainder(vectors)]) >> 11


def _remainder(vectors: np.ndarray) -> np.ndarray:
    rest = vectors.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def fuzzy_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment value: its index, and the indices around it as offsets and values."""
    values = np.arange(1 << BITS)
    home = golay_index(values)
    around = np.stack([home, *(home[values ^ (1 << b)] for b in range(BITS))], axis=1)
    around.sort(axis=1)
    fresh = np.ones(around.shape, bool)
    fresh[:, 1:] = around[:, 1:] != around[:, :-1]
    return home, np.r_[0, np.cumsum(fresh.sum(axis=1))], around[fresh]


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """``(key, fp, probe)``: each fingerprint's home keys and probe keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, offsets, around = fuzzy_table()
        for batch in batches:
            signed = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [(signed.view(np.uint64) >> np.uint64(BITS * s) & np.uint64(0xFFFF)).astype(np.int64) for s in range(SEGMENTS)]
            for s in range(SEGMENTS):
                fixed = s << 28 | parts[s] << 12
                fuzzy = parts[(s + 1) % SEGMENTS]
                n = offsets[fuzzy + 1] - offsets[fuzzy]
                at = np.repeat(offsets[fuzzy] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                keys = np.concatenate([fixed | home[fuzzy], np.repeat(fixed, n) | around[at]])
                whose = np.concatenate([signed, np.repeat(signed, n)])
                probe = np.arange(len(keys)) >= len(signed)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(whose), pa.array(probe)], ["key", "fp", "probe"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints within the distance."""
    keys = fuzzy_keys(fps)
    home = keys.filter("NOT probe").select("key", F.col("fp").alias("a"))
    probe = keys.filter("probe").select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return home.join(probe, "key").filter(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; the id is the smallest one reachable."""
    marked = store(fingerprints(docs), "fingerprints")
    nodes = store(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    grouped = components(links(nodes), "a", "b").select(F.col("node").alias("fp"), "component")
    named = nodes.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # only fingerprints with links meet here, so that the exchange stays small
    linked = named.join(grouped.select("fp"), "fp", "left_semi")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    ids = named.join(least, "component", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One document of each group: the one with the smallest id; columns are kept.

    ``groups`` has the ``component_id`` of every ``doc_id``; by default that of the fingerprints.

    Repeated rows of that id and text are one document. Of documents without an id, those
    stay whose whole group has none, one for each text.
    """
    groups = near_duplicates(docs) if groups is None else groups
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    # structs of null are equal: so one key serves the join and the grouping, and texts are shuffled once
    keyed = docs.withColumn("_key", F.struct("doc_id"))
    kept = keyed.join(first.select(F.struct("doc_id").alias("_key")), "_key", "left_semi")
    return kept.dropDuplicates(["_key", "text"]).select(*docs.columns)
