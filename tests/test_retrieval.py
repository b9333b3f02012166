"""The retrieval plans on a small corpus."""

import time

import pytest
from pyspark.sql import functions as F

from sextant.catalog.base import passage_matches
from sextant.plans import retrieval as P
from sextant.settings import Settings

DOCS = "tenant_id string, kb_id string, doc_id string, text string, file_name string, source_uri string, metadata map<string,string>"
QUERY = "query_id string, tenant_id string, kb_id string, query string, top_k long, mode string, metadata_filter map<string,string>"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("t", "k", "d1", "Pumps need oil every month.", "a.txt", "u1", {"owner": "x"}),
        ("t", "k", "d2", "Pumps need oil every year.", "b.txt", "u2", {"owner": "y"}),
        ("t", "other", "d3", "Pumps need oil every day.", "c.txt", "u3", {"owner": "x"}),
    ]
    return P.build_index(spark.createDataFrame(rows, DOCS))


def test_filters_hold_in_every_channel(spark, index):
    asked = [
        (f"{mode}-{name}", "t", "k", "pumps need oil", 5, mode, wanted)
        for mode in ("hybrid", "vector", "keyword")
        for name, wanted in (("owner", {"owner": "x"}), ("doc", {"doc_id": "d2"}), ("all", None), ("none", {"owner": "z"}))
    ]
    asked += [("big", "t", "k", "pumps", 51, "hybrid", None), ("odd", "t", "k", "pumps", 5, "best", None)]
    queries = spark.createDataFrame(asked, QUERY)
    found = {}
    for r in P.retrieve(queries, index).collect():
        found.setdefault(r["query_id"], set()).add(r["doc_id"])
    for mode in ("hybrid", "vector", "keyword"):
        assert found[f"{mode}-owner"] == {"d1"} and found[f"{mode}-doc"] == {"d2"}
        assert found[f"{mode}-all"] == {"d1", "d2"} and f"{mode}-none" not in found
    assert sorted((r["query_id"], r["reason"]) for r in P.rejected_queries(queries).collect()) == [
        ("big", "top_k must be from 1 to 50"), ("odd", "unknown mode"),
    ]


def test_chunks_carry_their_own_keys(index):
    row = index.chunks.filter("doc_id = 'd1' AND chunk_type = 'child'").first()
    assert row["metadata"]["doc_id"] == "d1" and row["metadata"]["chunk_id"] == row["chunk_id"]
    assert row["metadata"]["parent_id"] == row["parent_id"] and row["metadata"]["owner"] == "x"


def test_short_passages_are_matched(spark):
    docs = spark.createDataFrame([("a", "x one two three y"), ("b", "none of it"), ("c", "sone two threes")], "doc_id string, text string")
    items = [(1, "one two three"), (2, "one two"), (3, "of"), (4, "x"), (5, ""), (6, "none of it and more words than that")]
    got = passage_matches(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "c"), (2, "a"), (2, "c"), (3, "b"), (4, "a")]


def test_rerank_choices(spark, index):
    queries = spark.createDataFrame([("q", "t", "k", "pumps need oil", 5, "keyword", None)], QUERY)

    def found(**chosen):
        rows = P.retrieve(queries, index, **chosen).collect()
        return {r["doc_id"]: (r["rerank_method"] if "rerank_method" in r else None, r["score"]) for r in rows}

    by_function = found(reranker=lambda query, text: F.when(text.contains("year"), 0.9).otherwise(0.1))
    assert by_function["d2"][0] == "model" and by_function["d2"][1] > by_function["d1"][1]
    # no answer of the function: words are compared
    no_answer = found(reranker=lambda query, text: F.lit(None).cast("double"))
    assert {d: round(s, 6) for d, (_, s) in no_answer.items()} == {d: round(s, 6) for d, (_, s) in found().items()}
    off = found(settings=Settings(rerank_enabled=False))
    # scores are those of the search then, and its threshold holds for them
    assert off and off.keys() <= {"d1", "d2"} and all(method is None for method, _ in off.values())


def test_passages_of_long_texts_are_matched_in_linear_time(spark):
    # a text was split again at each of its places: a minute for this one
    body = " ".join(f"word{i}" for i in range(60_000))
    docs = spark.createDataFrame([("a", body)], "doc_id string, text string")
    items = [(1, "ord59990 word59991 word59992 word59993 word5999"), (2, "word1 word3 word5 word7"), (3, "59999")]
    started = time.perf_counter()
    got = passage_matches(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (3, "a")]
    assert time.perf_counter() - started < 30
