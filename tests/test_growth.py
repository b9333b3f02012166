"""Work that must not grow with the square of a text, a tenant or a term list."""

import time

from pyspark.sql import functions as F

from sextant.catalog import texts as catalog_texts
from sextant.operators import fusion
from sextant.functions import lexical as L
from sextant.operators import keyword as K
from sextant.operators import tenancy as T
from sextant.operators import windows as W


def test_long_phrase_is_stripped_in_linear_time(spark):
    # both patterns were tried once for each character of the phrase
    text = "请问" + "a1 b2 " * 8000 + "是什么"
    started = time.perf_counter()
    got = spark.createDataFrame([(text,)], "q string").select(L.strip_question_words("q")).first()[0]
    assert got == ("a1 b2 " * 8000).strip()
    assert time.perf_counter() - started < 15


def test_rounds_of_openings_and_closings_go_on(spark):
    rows = spark.createDataFrame([("请问 关于付款条件有哪些内容呢",), ("plain words",), ("请",)], "q string")
    assert [r[0] for r in rows.select(L.strip_question_words("q")).collect()] == ["付款条件", "plain words", ""]


def test_all_bases_of_one_tenant_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "ALL_BLOCK", 20)
    asks = spark.range(2000).select(
        F.col("id").alias("request_id"), F.lit(1).cast("long").alias("tenant_id"),
        F.when(F.col("id") < 1990, F.lit("all")).otherwise(F.lit("same")).alias("kb_ref"), F.array().cast("array<string>").alias("kb_ids"),
    ).coalesce(1)
    bases = spark.range(30).select(
        (F.col("id") + 100).alias("kb_id"), F.lit(1).cast("long").alias("tenant_id"), F.lit(0).alias("deleted"), F.lit("same").alias("name"),
    ).coalesce(1)
    found, missing = T.resolve_knowledge_bases(asks, bases)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 1990 * 30 + 10 and missing.count() == 0
    assert {r["kb_id"] for r in rows if r["request_id"] >= 1990} == {"100"}
    assert len({r["task"] for r in rows if r["request_id"] < 1990}) > 1


def test_pairs_are_scored_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "_BLOCK_CHARS", 40)
    monkeypatch.setattr(K, "_BLOCK_QUERIES", 1)
    texts = ["Pumps need oil", "oil pumps", "x" * 70 + "oil", "none", "", None, "泵需要每月加油", "need oil"]
    chunks = spark.createDataFrame([("t", "k", f"c{i}", x) for i, x in enumerate(texts)], "tenant_id string, kb_id string, chunk_id string, text string")
    asked = spark.createDataFrame(
        [("q1", "t", "k", "pumps need oil"), ("q2", "t", "k", "每月加油"), ("q3", "t", "other", "oil")],
        "query_id string, tenant_id string, kb_id string, query string",
    )
    pairs = K.scored_pairs(asked, chunks)
    got = {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in pairs.collect()}
    wanted = asked.join(chunks, ["tenant_id", "kb_id"]).select(
        "query_id", "chunk_id", L.keyword_score(L.search_terms("query"), "text").alias("score")
    )
    assert got == {(r["query_id"], r["chunk_id"]): round(r["score"], 9) for r in wanted.collect() if r["score"] > 0}
    # the pairs leave the blocks as they are: no match of a term is a row
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("FlatMapCoGroupsInArrow")


def test_windows_of_many_short_keys(spark):
    # each key and chunk was a Python group of its own, three times
    events = spark.range(60_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 20_000).cast("string").alias("user"),
        F.timestamp_seconds((F.floor(F.col("id") / 20_000) * 40).cast("double")).alias("ts"),
    )
    started = time.perf_counter()
    rows = W.rate_limit(events, "user", "ts", "event_id", 60, 1).groupBy(F.floor(F.col("event_id") / 20_000).alias("at"), "allowed").count().collect()
    assert time.perf_counter() - started < 20
    assert sorted(map(tuple, rows)) == [(0, True, 20_000), (1, False, 20_000), (2, True, 20_000)]


def test_hits_meet_texts_without_a_shuffle_of_the_texts(spark):
    """A few hits go to the texts; parents of no hit go nowhere."""
    chunks = spark.range(40).selectExpr(
        "'t' tenant_id", "'k' kb_id", "cast(id as string) chunk_id", "cast(id % 4 as string) doc_id", "cast(id % 4 as string) parent_id",
        "if(id < 4, 'parent', 'child') chunk_type", "concat('text ', id) text", "'f' file_name", "'s' source_uri", "cast(null as int) page", "map('a', 'b') metadata",
    ).rdd.toDF(schema="tenant_id string, kb_id string, chunk_id string, doc_id string, parent_id string, chunk_type string, text string, "
               "file_name string, source_uri string, page int, metadata map<string,string>")
    hits = chunks.filter("chunk_id in ('7', '9')").selectExpr("'q' query_id", "tenant_id", "kb_id", "chunk_id", "parent_id")
    found = fusion.attach_texts(hits, chunks)
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2
    assert sorted((r["chunk_id"], r["text"], r["parent_text"]) for r in found.collect()) == [("7", "text 7", "text 3"), ("9", "text 9", "text 1")]


def test_lines_are_normalised_once(spark, tmp_path):
    """The filter for texts without lines reads the raw text, not lines made for it alone."""
    texts = ["a  b\n\nA b", " \n\t", "", None, "　", "\x1f", "合 同", "\x00", "the "]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (catalog_texts.normalize_cjk_lines, catalog_texts.normalize_recognised_lines):
        found = query(spark, str(tmp_path))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("array_join") == 1
        assert sorted(r["doc_id"] for r in found.collect()) == [0, 6, 7, 8]
