"""Spelling variants: the index against brute force, the operator against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sextant.llm import spelling
from sextant.llm.fm_index import FmIndex

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_near(words):
    """Near words by their common holes, for tables that are too long for all pairs."""
    held = {}
    for w in words:
        for k in range(len(w)):
            held.setdefault((k, w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for group in held.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for x in {w[:k] + w[k + 1 :] for k in range(len(w))} & near.keys():
            near[w].add(x)
            near[x].add(w)
    return near


def plain(docs, chars=7, times=2):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= chars
    n = {w: k for w, k in n.items() if k >= times}
    near, form, out = plain_near(n), {}, []
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("seed", range(24))
def test_searches_find_each_near_word_once(seed):
    rng = random.Random(seed)
    letters = ("ab", "abc", "abcdé")[seed % 3]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.choice([1, 2, 60, 200]))})
    index, asked = FmIndex(words), []
    for k, w in enumerate(words):
        cuts = sorted({0, len(w) // 2, len(w), *(rng.randrange(len(w) + 1) for _ in range(seed % 4))})
        asked += [(k, a, b) for a, b in zip(cuts, cuts[1:])]
    q, x = index.near(*(np.array(c) for c in zip(*asked)))
    found = [(words[asked[a][0]], index.words[b]) for a, b in zip(q, x)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if apart_by_one(a, b)}


def test_long_words():
    words = ["a" * 3000, "a" * 3001, "a" * 1500 + "b" + "a" * 1499, "b" * 3000]
    index = FmIndex(words)
    half = index.lengths // 2
    number = np.arange(4)
    q, x = index.near(np.tile(number, 2), np.concatenate([0 * half, half]), np.concatenate([half, index.lengths]))
    assert Counter(index.words[k % 4] for k in q) == {"a" * 3000: 2, "a" * 3001: 1, "a" * 1500 + "b" + "a" * 1499: 1}


def frame(spark, docs):
    # extra columns with the names that the operator makes
    return spark.createDataFrame([(*d, 1, "w", 2) for d in docs], "doc_id long, text string, n int, word string, key int")


def docs():
    rng = random.Random(3)
    base = ["frequent", "Frequènt", "colouring", "organise", "beginnings", "a" * 400]
    found = [(i, " ".join(rng.choices(base, k=40))) for i in range(30)]
    variants = []
    for w in base:
        for k in range(len(w)):
            variants += [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :]]
    for i in range(20):
        found.append((100 + i, "-".join(rng.choices(variants, k=200))))
    # a beginning and an end that many words share
    found += [(200 + i, " ".join("sharedbeginning" + "".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(80))) for i in range(8)]
    found += [(300 + i, " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) + "sharedend" for _ in range(80))) for i in range(8)]
    found += [(400, None), (401, ""), (None, "nullident nullident nullidentx " * 20), (402, "\n\t 12 ÷××÷××÷ ÷××÷××÷ ÷××÷×××")]
    # rows that repeat, one long run of letters
    return found + found[:3] + [(500, "é" * 5000), (501, "é" * 5000), (502, "é" * 4999 + "Z"), (503, "é" * 4999 + "z")]


@pytest.mark.parametrize("shard, limit", [(spelling.SHARD, spelling.LIMIT), (64, 30)])
def test_near_words_of_hot_halves(spark, shard, limit):
    want = [(w, near, n) for w, _, _, n, near, _ in plain(docs())]
    words = spark.createDataFrame([(w, n) for w, _, n in want], "word string, n long")
    got = {r["word"]: r for r in spelling.near_words(words, shard=shard, limit=limit).collect()}
    assert {w: r["n_near"] for w, r in got.items()} == {w: near for w, near, _ in want if near}


def test_windows_shrink_until_no_key_is_hot_or_they_are_one_letter(spark):
    words = spark.createDataFrame([(w, n) for w, _, _, n, *_ in plain(docs())], "word string, n long")
    def largest(rows):
        return rows.filter("last - first > 1").groupBy("key").count().agg({"count": "max"}).first()[0]

    # each level leaves at most 40 rows under a key, and a few levels can meet under one
    assert largest(spelling.windows(words)) > 200 >= largest(spelling.refined(spelling.windows(words), 40))


def test_variants(spark):
    got = [tuple(r) for r in spelling.variants(frame(spark, docs())).collect()]
    want = plain(docs())
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(form for _, form, *_ in want)


def test_chains_of_forms_are_followed(spark):
    chain = ["a" * k for k in range(7, 12)]
    docs = [(i, " ".join([w] * 3 * 11**k)) for i in (1, 2) for k, w in enumerate(chain[:4])]
    got = {r["word"]: r for r in spelling.variants(frame(spark, docs)).collect()}
    assert sorted(map(tuple, got.values()), key=repr) == sorted(plain(docs), key=repr)
    assert max(len(r["root"]) - len(w) for w, r in got.items()) >= 2


def test_empty_table(spark):
    assert spelling.variants(frame(spark, docs()).limit(0)).collect() == []
    assert spelling.variants(frame(spark, [(1, None), (2, "short words only")])).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, spelling.variants(docs).collect()), key=repr)
    assert got == sorted(plain([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
