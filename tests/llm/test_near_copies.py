"""The near-duplicate stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import numpy as np
from test_duplicates import groups

from sextant.llm import near_copies, simhash


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    size = min(5, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def plain_kept(rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return {i for i, g in groups(sets, near).items() if i == g}


def stage(spark, docs):
    return corpus_pipeline.near_duplicates(spark, docs, "")


def test_stage_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = [r["doc_id"] for r in stage(spark, docs).collect()]
    assert sorted(got) == sorted(want) and {643, 2} <= want and not {56, 770, 944} & want


def test_stage_of_chains_and_boilerplate(spark):
    rng = random.Random(6)
    rows = [(0, None), (1, " "), (2, "one two"), (3, "One  two"), (4, "one two three")]
    shared = [f"s{k}" for k in range(60)]
    for _ in range(12):  # each text a few words from the one before, and one passage in all of them
        text = shared + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((20, 60)))]
        for _ in range(15):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int")
    got = stage(spark, docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(plain_kept(rows))
    assert stage(spark, docs.limit(0)).collect() == []


def test_large_texts_with_a_common_passage_are_not_verified_whole(spark, monkeypatch):
    rng = random.Random(3)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passages = [words(60) for _ in range(2)]
    rows = [(k, " ".join([*words(1500), *passages[k % 2], *words(1500)])) for k in range(16)]
    stem = words(400)
    for k in range(16, 24):  # a family about the threshold
        at = rng.randrange(330)
        rows.append((k, " ".join([*stem[:at], *words(30), *stem[at + 30 :]])))
    docs, made = spark.createDataFrame(rows, "doc_id long, text string"), []
    real, none = near_copies.store, np.empty(0, np.int64)

    def counted(table, purpose):
        out = real(table, purpose)
        made.extend([out.count()] if purpose == "shingle-sets" else [])
        return out

    monkeypatch.setattr(near_copies, "store", counted)
    # in a large table, a passage of few texts is not seen in the sample
    monkeypatch.setattr(near_copies, "common_shingles", lambda *_: (none, none))
    got = near_copies.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] == r["component_id"]) == sorted(plain_kept(rows))
    assert sum(made) <= 16 and max(made) <= 8


def test_bitmaps_of_two_widths(spark):
    found = near_copies.shingles(" ".join(f"w{k}" for k in range(1030)))
    small, large = near_copies.bitmap(found[:1020]), near_copies.bitmap(found)
    assert 2 * len(small) == len(large) and len(near_copies.bitmap(found[:0])) * 64 == near_copies.BITS
    words = [f"w{k}" for k in range(1040)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:1020])), (2, " ".join(words[:800]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in stage(spark, docs).collect()} == plain_kept(rows) == {0, 2}


def test_texts_are_shuffled_once_to_keep_the_first(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (3, "c"), (None, "d"), (None, "d"), (None, "e"), (1, "f"), (4, None), (4, None)]
    groups = [(1, 1), (1, 1), (2, 1), (3, 3), (None, None), (4, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_first(docs, spark.createDataFrame(groups, "doc_id long, component_id long"))
    want = [(1, "a b"), (1, "f"), (3, "c"), (4, None), (None, "d"), (None, "e")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    large = spark.range(10).selectExpr("id AS doc_id", "string(id) AS text").repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_first(large, spark.range(10).selectExpr("id AS doc_id", "id AS component_id").repartition(2))
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(_key") == 2 and ", text#" not in "".join(
        x for x in plan.splitlines() if "Exchange hashpartitioning" in x
    )
