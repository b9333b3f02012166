"""SimHash groups, repeated strings and embedding groups against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from sextant.llm import embedding_blocks, simhash, suffix_buckets
from sextant.llm.components import components


def groups(nodes, near):
    """Smallest node reachable, by union-find."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    edges += [(5000, k) for k in range(5001, 5400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long"), "a", "b").collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    want = groups({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for n in linked}


def test_golay_code_is_perfect_and_keys_meet():
    patterns = [0] + [1 << a for a in range(23)]
    assert len(set(simhash.golay_index(np.arange(1 << 23, dtype=np.int64)[:: 997]))) > 3000
    rng = np.random.default_rng(0)
    messages = rng.integers(0, 4096, 50) << 11
    words = messages | simhash._remainder(messages)
    for e in patterns:
        assert (simhash.golay_index(words ^ e) == words >> 11).all()
    home, offsets, around = simhash.fuzzy_table()
    for v in rng.integers(0, 1 << 16, 200):
        near = {int(home[v])} | {int(home[v ^ (1 << b)]) for b in range(16)}
        assert set(around[offsets[v] : offsets[v + 1]].tolist()) == near


def test_fingerprints_equal_the_native_hash(spark):
    texts = ["a b c d e", "One two", "", "  ", "É é x", "q " * 500]
    for text in texts:
        w = text.encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]).decode() for k in range(max(1, len(w) - 2))] if w else []
        hashes = [r[0] % (1 << 64) for r in spark.createDataFrame([(s,) for s in shingles], "s string").selectExpr("xxhash64(s)").collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_simhash_groups(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}


def test_simhash_documents(spark):
    rows = [(1, None), (2, ""), (3, "  "), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "one"), (8, "One")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.digest(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (None, 5), (5, 5), (5, 5), (7, 7), (8, 7)], key=str)
    kept = simhash.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 7] and kept.columns == docs.columns
    assert simhash.digest(docs.limit(0)).collect() == []


def plain_repeats(texts, depth=400):
    data = [(t or "").encode() for t in texts]

    def key(b, i):
        return hashlib.blake2b(b[i : i + depth], digest_size=16).digest()

    times = Counter(key(b, i) for b in data for i in range(len(b) - depth + 1))
    out = []
    for b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if times[key(b, i)] > 1:
                mask[i : i + depth] = b"\1" * depth
        spans = sum(m and not p for m, p in zip(mask, b"\0" + bytes(mask)))
        left = bytes(x for x, m in zip(b, mask) if not m)
        out.append((len(b), sum(mask), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
    return out


def test_repeated_strings(spark):
    rng = random.Random(4)

    def words(n):
        return " ".join("".join(rng.choice("abcdeéf") for _ in range(rng.randint(1, 7))) for _ in range(n))

    base, passage = words(600), words(120)
    texts = [None, "", "x" * 300, "a" * 1500, "ab" * 700, base, base, words(50)]
    for _ in range(12):
        some = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            some[rng.randrange(len(some))] = words(1)
        texts.append(words(rng.randint(0, 60)) + " ".join(some[rng.randint(0, 200) : rng.randint(300, 600)]) + words(9))
        texts.append(words(rng.randint(0, 99)) + passage[rng.randint(0, 150) : rng.randint(400, len(passage))] + words(30))
    for n in (399, 400, 401):
        part = words(150)[:n]
        texts += [words(20) + "Q" + part + "R", words(30) + "S" + part + "T" + words(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_buckets.digest(docs).collect()}
    assert [got[k] for k in range(len(texts))] == plain_repeats(texts)


def test_repeated_rows_and_names(spark):
    rows = [(1, None, 5), (None, "y" * 500, 6), (3, "y" * 500, 7), (3, "y" * 500, 8), (4, "é" * 150, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d int")
    left = suffix_buckets.remove_repeats(docs)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, None, 5), (None, "", 6), (3, "", 7), (3, "", 8), rows[4]], key=str)
    assert left.columns == docs.columns and suffix_buckets.digest(docs.limit(0)).collect() == []


def test_a_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcd ") for _ in range(5000))
    twice = text + "X" + text[1000:2000]
    import pyarrow as pa

    monkeypatch.setattr(suffix_buckets, "CHUNK", 1500)
    covered = set()
    for data, rows, begins, firsts in suffix_buckets.pieces(pa.array([twice])):
        start, n, _, _ = suffix_buckets.find_runs(data, begins)
        for a, k in zip(start, n):
            piece = np.searchsorted(begins, a, "right") - 1
            covered |= set(range(a - begins[piece] + firsts[piece], a - begins[piece] + firsts[piece] + k))
    assert covered == set(range(len(twice) - 399))


def test_embedding_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    vectors = np.concatenate([centres + s * rng.standard_normal((30, 16)) for s in (0, 0.05, 0.1, 0.15, 0.2) for _ in range(3)])
    labels = np.arange(len(vectors)) % 30 % 3
    rows = [(k, v.astype(np.float32).tolist(), int(lab)) for k, (v, lab) in enumerate(zip(vectors, labels))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    want = groups(range(len(x)), zip(*np.nonzero(near)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_blocks.near_duplicates(frame, blocks=3).collect()}
    assert near.sum() > 200
    assert got == {k: (int(near[k].sum()), int(want[k]), k == want[k]) for k in range(len(x))}


def test_embeddings_that_link_with_nothing(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.1], 1), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [1.0, float("nan")], 1), (8, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (10, [1.0], 1), (12, [1.0, None], 2), (13, [], 1),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_blocks.near_duplicates(frame).collect()}
    assert got == {
        **{k: (4, 1, k == 1) for k in (1, 2, 3, 4)}, None: (4, 1, False), **{k: (0, k, True) for k in (5, 6, 7, 8, 10, 12, 13)}
    }
    assert embedding_blocks.near_duplicates(frame.limit(0)).collect() == []


def test_embeddings_of_several_lengths(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (4, [1.0, 2.0, 0.001]), (5, [3.0]), (6, [0.5]), (7, [-1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_blocks.near_duplicates(frame).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
