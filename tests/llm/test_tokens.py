"""BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sextant.llm import bpe, packing, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encode(vocab, texts):
    out = []
    for _, group in bpe.text_groups(texts):
        ids, counts = vocab.encode(group)
        ends = np.cumsum(counts)
        out += [ids[e - c : e].tolist() for e, c in zip(ends, counts)]
    return out


@pytest.mark.parametrize("kind", [bpe.Vocabulary, packing.FastVocabulary])
def test_ids_equal_the_library(library, kind):
    rng = random.Random(1)
    parts = ["'s", "'t", "'re", "'", "''", " ", "  ", "\n", "\t", "\xa0", "a", "the", " The", "1", "23", "!", "!!", "é", "日本", "\U0001f600"]
    parts += ["<|endoftext|>", "'ll", "'LL", "d", "ve", "\x1c", "\x00", "\x85", "²", "½", "ͤ", "Ᲊ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 60))) for _ in range(8000)]
    texts += [None, "", "<|endoftext|>", "a" * 5000, "abab" * 3000, " " * 3000, "the" * 4000, "=" * 3000]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    vocab = kind(PATH)
    assert encode(vocab, texts) == want
    assert all(vocab.decode(np.array(x, np.int64)).decode() == (t or "") for x, t in zip(want, texts))


def test_round_trip_query(spark, library):
    rows = [(1, None), (2, ""), (None, "x"), (3, "a<|endoftext|>b"), (3, "a<|endoftext|>b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), PATH).collect() == []


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    for n, windows in ((1, 1), (3, 5), (40, 4), (400, 7)):
        sizes = rng.integers(1, 100, n)
        window = packing.difference(sizes, windows)
        sums = np.bincount(window, sizes, windows)
        assert window.max() < windows and sums.sum() == sizes.sum()
        if n >= 40:
            assert sums.max() - sums.min() <= 4
    window = packing.near_equal_windows(np.full(5, 600), 1024)
    assert np.bincount(window, np.full(5, 600)).max() <= 1024  # more windows than the sum needs


def test_packing(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b"), (-3, "a b"), (None, "q")], "doc_id long, text string")
    rows = packing.pack(docs.union(odd), PATH, with_ids=True).collect()
    sequences, texts = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    padding = sum(1024 - t for t in (sum(n for _, n in p) for p in sequences.values()) if t & (t - 1))
    assert padding < 0.05 * 1024 * len(sequences)
    for row in docs.collect():
        ids = np.array(library.encode(row["text"], add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(texts[row["doc_id"]], key=lambda r: r["start"])
        assert sum((p["ids"] for p in parts), []) == ids.tolist() and parts[0]["doc_tokens"] == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in parts)
    assert len(texts[-3]) == 2 and len(texts[-1]) == len(texts[-2]) == len(texts[None]) == 1
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_token_files(spark, library):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    rows = [(1, None), (None, ""), (-5, "a<|endoftext|>b"), ((1 << 63) - 1, "x"), (-(1 << 63), "y z"), (7, "w " * 400), (7, "w " * 400)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(2)
    want = sorted(((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    path = token_files.write(docs, PATH)
    for block in (1 << 18, 100, 3):
        assert sorted(map(tuple, token_files.scan(spark, path, block=block).collect()), key=str) == want
    assert token_files.scan(spark, token_files.write(docs.limit(0), PATH)).collect() == []


def test_files_of_other_makers(spark, tmp_path):
    ids = np.array([5, 6, 50256, 50256, 7, 50256, 8, 9, 10], "<u2")
    (tmp_path / "t.bin").write_bytes(ids.tobytes())
    for block in (100, 2, 1):
        got = token_files.scan(spark, str(tmp_path), has_header=False, block=block).collect()
        assert sorted(map(tuple, got)) == [(0, 2), (3, 0), (4, 1), (6, 3)]
