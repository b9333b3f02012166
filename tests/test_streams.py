import json

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.catalog import streams as catalog_streams
from sextant.operators import storage as S
from sextant.operators.chunking import chunk_rows
from sextant.operators import windows as W
from sextant.operators import vector_search as N
from sextant.settings import Settings
from sextant.streaming import ingest as I
from sextant.streaming import jobs as J

SECOND = 1_000_000


def test_job_state_machine():
    state, decision, _ = J.next_state(None, "deliver", False, 0)
    assert (state[1], decision) == (1, "process")
    assert J.next_state(state, "deliver", False, 10)[1] == "skip_processing"
    assert J.next_state(state, "deliver", True, 10) == (state, "rerun", 0)
    assert J.next_state(state, "deliver", False, 1800 * SECOND)[1] == "process"
    for attempt, wait in ((1, 1), (2, 2)):
        state, decision, seconds = J.next_state(state, "error", False, 20)
        assert (decision, seconds) == ("retry", wait)
        state, decision, _ = J.next_state(state, "deliver", False, 30)
        assert decision == "process" and state[1] == attempt + 1
    state, decision, _ = J.next_state(state, "error", False, 40)
    assert decision == "dead_letter" and state[0] == "failed"
    assert J.next_state(state, "deliver", False, 50)[1] == "skip_failed"
    assert [J.backoff_seconds(n) for n in (1, 2, 5, 6, 40)] == [1, 2, 16, 30, 30]


def test_anchored_windows_of_a_hot_key_equal_the_plain_fold(spark):
    rng = np.random.default_rng(5)
    gaps = np.concatenate([rng.integers(1, 9, 4000), rng.integers(1, 4000, 300)])
    hot = np.cumsum(gaps)
    rows = [("hot", int(t), i) for i, t in enumerate(hot)] + [("cold", 5, 9001), ("cold", 5, 9002), ("cold", 70, 9003)]
    events = spark.createDataFrame(rows, "k string, sec long, id long").withColumn("ts", F.timestamp_seconds("sec"))
    got = {(r["k"], r["id"]): r for r in W.rate_limit(events, "k", "ts", "id", 10, 3).collect()}
    start = count = None
    for k, t, i in rows:
        if k != "hot":
            continue
        if start is None or t >= start + 10:
            start, count = t, 0
        count += 1
        assert got[(k, i)]["window_start"] == start * SECOND
        assert got[(k, i)]["allowed"] == (count <= 3)
    assert got[("cold", 9002)]["window_start"] == 5 * SECOND and got[("cold", 9003)]["window_start"] == 70 * SECOND


def _message(**fields):
    return json.dumps({"tenantId": "t", "kbId": "k", **fields})


def test_ingest_stream_is_idempotent_and_keeps_deletions(spark, tmp_path):
    tables = I.IngestTables(str(tmp_path / "tables"), Settings(child_chunk_size=60, child_chunk_overlap=10))
    queue = tmp_path / "queue"
    queue.mkdir()

    def run():
        messages = spark.readStream.text(str(queue))
        I.start_ingest(messages, tables, str(tmp_path / "marks")).awaitTermination()

    body = "alpha beta gamma delta. " * 10
    (queue / "1.txt").write_text(
        "\n".join([_message(docId="a", content=body), _message(docId="b", content=body), "broken", json.dumps({"tenantId": "t"})])
    )
    run()
    first = tables.chunks(spark)
    assert {r["doc_id"] for r in first.collect()} == {"a", "b"}
    assert tables.dead_letters(spark).count() == 2
    children = first.filter("chunk_type = 'child'")
    assert tables.vectors(spark).count() == children.count() > 2
    # the same job again is skipped; a job with its own id replaces the document
    (queue / "2.txt").write_text("\n".join([_message(docId="a", content="ignored"), _message(docId="b", jobId="j2", content="short text")]))
    run()
    texts = {r["doc_id"]: r["text"] for r in tables.chunks(spark).filter("chunk_type = 'parent'").collect()}
    assert texts["a"] == body.strip() and texts["b"] == "short text"
    # a replay of a batch changes nothing
    before = sorted(map(str, tables.chunks(spark).collect()))
    tables.ingest(spark.read.text(str(queue / "2.txt")), 1)
    assert sorted(map(str, tables.chunks(spark).collect())) == before
    # deleted documents stay away
    tables.delete(spark.createDataFrame([("t", "k", "a")], "tenant_id string, kb_id string, doc_id string"))
    (queue / "3.txt").write_text(_message(docId="a", jobId="j3", content="back again"))
    run()
    assert {r["doc_id"] for r in tables.chunks(spark).collect()} == {"b"}
    assert {r["doc_id"] for r in tables.vectors(spark).collect()} == {"b"}
    assert "[configured]" not in str(tables.jobs(spark).first()["payload"])


def test_blocked_search_equals_one_block(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8)).round(3)
    rows = [("t", "k", str(i), [float(x) for x in v]) for i, v in enumerate(data)]
    vectors = spark.createDataFrame(rows, "tenant_id string, kb_id string, chunk_id string, vector array<float>")
    queries = vectors.limit(12).select(F.col("chunk_id").alias("query_id"), "tenant_id", "kb_id", F.lit(7).cast("long").alias("top_k"), "vector")
    small = N.exact_search(queries, vectors, "L2", Settings(vector_block_rows=37, query_block_rows=5))
    one = N.exact_search(queries, vectors, "L2")
    assert sorted(map(str, small.collect())) == sorted(map(str, one.collect()))
    best = {r["query_id"]: r["chunk_id"] for r in one.filter("rank = 1").collect()}
    assert all(k == v for k, v in best.items()) and one.count() == 84


def test_a_deletion_takes_no_other_document_and_the_later_message_wins(spark, tmp_path):
    tables = I.IngestTables(str(tmp_path / "tables"))
    scope = "tenant_id string, kb_id string, doc_id string"
    messages = [_message(docId="a", jobId="z", content="old text"), _message(docId="a", jobId="b", content="new text"), _message(docId="c", content="other")]
    raw = spark.createDataFrame([(m, k) for k, m in enumerate(messages)], "value string, seq long")
    tables.ingest(raw, 0)
    tables.delete(spark.createDataFrame([("t", "k", "unknown")], scope))
    texts = {r["doc_id"]: r["text"] for r in tables.chunks(spark).filter("chunk_type = 'child'").collect()}
    assert texts == {"a": "new text", "c": "other"}
    tables.delete(spark.createDataFrame([("t", "k", "a")], scope))
    tables.ingest(spark.createDataFrame([(_message(docId="a", jobId="n", content="again"), 0)], "value string, seq long"), 1)
    assert {r["doc_id"] for r in tables.chunks(spark).collect()} == {"c"}


def test_a_change_rewrites_its_own_partitions_only(spark, tmp_path):
    table = S.DocumentTable(str(tmp_path / "t"), T.StructType.fromDDL("tenant_id string, kb_id string, doc_id string, text string"), buckets=4)

    def rows(found):
        return spark.createDataFrame(found, table.schema)

    first = rows([("t", f"k{i % 2}", f"d{i}", f"text {i}") for i in range(20)] + [("u", "k0", "d1", "other tenant")])
    table.replace(first, first)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    table.replace(rows([("t", "k0", "d2", None), ("t", "k0", "new", None)]), rows([("t", "k0", "new", "came")]))
    now = {r["doc_id"]: r["text"] for r in table.read(spark).filter("tenant_id = 't'").collect()}
    assert now == {f"d{i}": f"text {i}" for i in range(20) if i != 2} | {"new": "came"}
    kept = {p for p, at in files.items() if p.exists() and p.stat().st_mtime_ns == at}
    assert all("tenant_id=u" in str(p) or "kb_id=k1" in str(p) or p in kept for p in kept) and len(kept) >= len(files) // 2
    # a partition that loses its last document is overwritten too, and again
    for _ in range(2):
        table.delete(rows([("u", "k0", "d1", None), ("u", "k9", "unknown", None)]))
        assert table.read(spark).filter("tenant_id = 'u'").count() == 0
    plan = table.read(spark).filter("tenant_id = 't' AND kb_id = 'k1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan


def test_messages_that_name_a_file(spark, tmp_path):
    tables = I.IngestTables(str(tmp_path / "tables"), buckets=2)
    files = spark.createDataFrame([("/in/a.txt", "text of the file"), ("/in/b.txt", "another one")], "path string, text string")
    messages = [_message(docId="a", filePath="/in/a.txt"), _message(docId="b", filePath="/in/b.txt", content="its own text"),
                _message(docId="c", filePath="/in/missing.txt"), _message(docId="d")]
    raw = spark.createDataFrame([(m, k) for k, m in enumerate(messages)], "value string, seq long")
    for _ in range(2):
        tables.ingest(raw, 0, files=files)
        texts = {r["doc_id"]: r["text"] for r in tables.chunks(spark).filter("chunk_type = 'child'").collect()}
        assert texts == {"a": "text of the file", "b": "its own text"}
        assert sorted(r["reason"] for r in tables.dead_letters(spark).collect()) == ["file not found: /in/missing.txt", "filePath or content is required."]
        assert sorted(r["doc_id"] for r in tables.jobs(spark).collect()) == ["a", "b"]
    # the file may come later: its job is still open
    more = files.unionByName(spark.createDataFrame([("/in/missing.txt", "there now")], "path string, text string"))
    tables.ingest(raw, 1, files=more)
    assert {r["doc_id"] for r in tables.chunks(spark).collect()} == {"a", "b", "c"}


def test_ingested_rows_equal_the_chunks_of_the_documents(spark, tmp_path):
    """Ids, texts and vectors of an ingest over several batches, against one pass over the last texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.lit("t").alias("tenant_id"), F.col("lang").alias("kb_id"), F.col("doc_id").cast("string").alias("doc_id"), "text",
        F.lit(None).cast("string").alias("file_name"), F.lit("u").alias("source_uri"), F.create_map(F.lit("source"), F.lit("u")).alias("metadata"),
    )
    tables = I.IngestTables(str(tmp_path / "tables"))
    fields = [F.col(a).alias(b) for a, b in (("tenant_id", "tenantId"), ("kb_id", "kbId"), ("doc_id", "docId"), ("source_uri", "sourceUri"))]
    for batch, text in enumerate((F.lit("an older text"), F.col("text"))):
        message = F.to_json(F.struct(*fields, text.alias("content"), F.concat("doc_id", F.lit(f"-{batch}")).alias("jobId")))
        tables.ingest(docs.select(message.alias("value"), F.col("doc_id").cast("long").alias("seq")), batch)
    want = chunk_rows(docs).select("doc_id", "chunk_id", "text").collect()
    got = tables.indexed.read(spark)
    assert sorted(map(tuple, got.select("doc_id", "chunk_id", "text").collect())) == sorted(map(tuple, want))
    assert got.filter("chunk_type = 'child' AND vector IS NULL AND text RLIKE '[a-z]'").count() == 0


def test_named_files_of_the_ingest_query_are_whole(spark, tmp_path, monkeypatch):
    # the text of a file was one of its lines
    texts = {10: "Pumps need oil.\nThey run all day.\nOil is checked.", 11: "An inline text.\nIts second line."}
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, start = [], I.start_ingest
    monkeypatch.setattr(I, "start_ingest", lambda m, tables, marks, files: kept.append(tables) or start(m, tables, marks, files=files))
    rows = catalog_streams.ingest_stream(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {(str(i), True, True, False) for i in texts}
    parents = kept[0].chunks(spark).filter("chunk_type = 'parent'").select("doc_id", "text").collect()
    assert {int(i): t for i, t in parents} == texts
