"""Streaming operators, run over the given tables until the source is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog.base import documents, table
from sextant.catalog.registry import query
from sextant.operators import windows as W
from sextant.session import shared_dir
from sextant.streaming import ingest as I
from sextant.streaming import jobs as J

LIMIT, DAY = 2, 86400


def _chain(length: str, source: str, key: str) -> str:
    """Window starts of each key, one after the other."""
    return f"""starts(k, st) AS (
      SELECT {key}, min(ts) FROM {source} GROUP BY {key}
      UNION ALL
      SELECT s.k, (SELECT min(e.ts) FROM {source} e WHERE e.{key} = s.k AND e.ts >= s.st + INTERVAL {length})
      FROM starts s WHERE EXISTS (SELECT 1 FROM {source} e WHERE e.{key} = s.k AND e.ts >= s.st + INTERVAL {length})),
    placed AS (
      SELECT e.*, s.st FROM {source} e JOIN starts s ON s.k = e.{key} AND e.ts >= s.st AND e.ts < s.st + INTERVAL {length})"""


@query(
    "rate_limit", "STR8",
    f"""WITH RECURSIVE {_chain('1 DAY', 'events', 'user_id')}
    SELECT event_id, row_number() OVER (PARTITION BY user_id, st ORDER BY ts, event_id) <= {LIMIT} AS allowed FROM placed""",
)
def rate_limit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return W.rate_limit(events, "user_id", "ts", "event_id", DAY, LIMIT).select("event_id", "allowed")


@query(
    "answer_reuse", "STR9",
    f"""WITH RECURSIVE asks AS (
      SELECT event_id, ts, event_type || ':' || (user_id % 40) AS request_key, user_id % 9 = 0 AS deep FROM events),
    plain AS (SELECT * FROM asks WHERE NOT deep),
    {_chain('6 HOUR', 'plain', 'request_key')}
    SELECT event_id, first_value(event_id) OVER w AS answered_by, event_id <> first_value(event_id) OVER w AS reused FROM placed
    WINDOW w AS (PARTITION BY request_key, st ORDER BY ts, event_id)
    UNION ALL SELECT event_id, event_id, FALSE FROM asks WHERE deep""",
)
def answer_reuse(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat("event_type", F.lit(":"), (F.col("user_id") % 40).cast("string")).alias("request_key"),
        (F.col("user_id") % 9 == 0).alias("deep"),
    )
    return W.answer_reuse(requests, "request_key", "ts", "event_id", 6 * 3600, "deep").select("event_id", "answered_by", "reused")


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def _drain(spark, stream, purpose: str):
    """Run a stream to the end of its source into a table and read that table."""
    out, marks = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-marks")
    sink = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "rate_limit_stream", "STR8",
    f"""WITH RECURSIVE {_chain('1 DAY', 'events', 'user_id')}
    SELECT event_id, row_number() OVER (PARTITION BY user_id, st ORDER BY ts, event_id) <= {LIMIT} AS allowed FROM placed""",
)
def rate_limit_stream(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )
    return _drain(spark, J.stream_rate_limit(events, DAY, LIMIT), "limits").select("event_id", "allowed")


# job events: every user is one job; deliveries come twice as often as outcomes
_KINDS = """jobs AS (
  SELECT user_id AS k, event_id AS seq, epoch_us(ts) AS at, event_type = 'view' AS redelivered,
    CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 50 = 0 THEN 'ok' ELSE 'error' END
      WHEN 'error' THEN CASE WHEN event_id % 61 = 0 THEN 'invalid' ELSE 'error' END ELSE 'deliver' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""
_WAIT = "CASE WHEN f.attempts >= 6 THEN 30 ELSE least(CAST(pow(2, greatest(f.attempts - 1, 0)) AS INT), 30) END"


@query(
    "ingest_job_states", "STR3 STR4",
    f"""WITH RECURSIVE {_KINDS},
    fold(k, n, seq, status, attempts, updated, decision, wait) AS (
      SELECT k, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 'none', 0, CAST(0 AS BIGINT), '', 0 FROM jobs WHERE n = 1
      UNION ALL
      SELECT j.k, j.n, j.seq,
        CASE WHEN j.kind = 'deliver' THEN CASE WHEN f.status IN ('succeeded', 'failed') THEN f.status ELSE 'processing' END
             WHEN f.status <> 'processing' THEN f.status WHEN j.kind = 'ok' THEN 'succeeded'
             WHEN j.kind = 'invalid' OR f.attempts >= 3 THEN 'failed' ELSE 'retry_waiting' END,
        CASE WHEN j.kind = 'deliver' AND f.status = 'none' THEN 1
             WHEN j.kind = 'deliver' AND (f.status = 'retry_waiting' OR (f.status = 'processing' AND f.updated <= j.at - 1800000000)) THEN f.attempts + 1
             ELSE f.attempts END,
        CASE WHEN j.kind = 'deliver' AND (f.status IN ('none', 'retry_waiting') OR (f.status = 'processing' AND f.updated <= j.at - 1800000000)) THEN j.at
             WHEN j.kind <> 'deliver' AND f.status = 'processing' THEN j.at ELSE f.updated END,
        CASE WHEN j.kind = 'deliver' THEN CASE WHEN f.status IN ('none', 'retry_waiting') OR (f.status = 'processing' AND f.updated <= j.at - 1800000000) THEN 'process'
               WHEN f.status IN ('succeeded', 'failed') THEN 'skip_' || f.status WHEN j.redelivered THEN 'rerun' ELSE 'skip_processing' END
             WHEN f.status <> 'processing' THEN 'ignored' WHEN j.kind = 'ok' THEN 'complete'
             WHEN j.kind = 'invalid' OR f.attempts >= 3 THEN 'dead_letter' ELSE 'retry' END,
        CASE WHEN j.kind = 'error' AND f.status = 'processing' AND f.attempts < 3 THEN {_WAIT} ELSE 0 END
      FROM fold f JOIN jobs j ON j.k = f.k AND j.n = f.n + 1)
    SELECT CAST(k AS VARCHAR) AS job_key, seq, decision, CAST(attempts AS INTEGER) AS attempts, CAST(wait AS INTEGER) AS wait_seconds FROM fold WHERE n > 0""",
)
def ingest_job_states(spark, sf_dir):
    kind, number = F.col("event_type"), F.col("event_id")
    outcome = (
        F.when(kind == "purchase", F.when(number % 50 == 0, F.lit("ok")).otherwise(F.lit("error")))
        .when(kind == "error", F.when(number % 61 == 0, F.lit("invalid")).otherwise(F.lit("error")))
        .otherwise(F.lit("deliver"))
    )
    events = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("job_key"), number.alias("seq"), outcome.alias("kind"),
        (kind == "view").alias("redelivered"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    return _drain(spark, J.job_decisions(events), "jobs")


def message_texts(spark, sf_dir):
    """Documents as ingest messages; each tenth lacks its base, each eleventh its content, each seventh names a file instead."""
    doc = F.col("doc_id").cast("long")
    fields = F.struct(
        F.col("tenant_id").alias("tenantId"), F.when(doc % 10 != 7, F.col("kb_id")).alias("kbId"), F.col("doc_id").alias("docId"),
        F.col("file_name").alias("fileName"), F.col("source_uri").alias("sourceUri"), F.when((doc % 11 != 5) & (doc % 7 != 3), F.col("text")).alias("content"),
        F.when(doc % 7 == 3, F.concat(F.lit("in/"), "doc_id", F.lit(".txt"))).alias("filePath"),
        F.lit("k-1").alias("embeddingApiKey"),
    )
    return documents(spark, sf_dir).select(F.to_json(fields).alias("value"))


@query(
    "parse_ingest_messages", "STR1 SNK5",
    """SELECT CASE WHEN doc_id % 10 = 7 THEN 'kbId is required' WHEN doc_id % 11 = 5 AND doc_id % 7 <> 3 THEN 'filePath or content is required.' ELSE 'valid' END AS outcome,
      count(*) AS n FROM documents GROUP BY 1""",
)
def parse_ingest_messages(spark, sf_dir):
    jobs, rejected = I.parse_messages(message_texts(spark, sf_dir))
    both = jobs.select(F.lit("valid").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "ingest_stream", "STR1 STR5 STR6 SNK1 SNK2 SNK3 SNK5",
    """WITH m AS (
      SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN doc_id % 35 <> 3 ELSE doc_id % 11 <> 5 END AS has_text FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 13 <> 2 AND doc_id % 10 <> 7 AND has_text AS stored,
      doc_id % 13 <> 2 AND doc_id % 10 <> 7 AND has_text AS has_vectors, doc_id % 10 = 7 OR NOT has_text AS dead FROM m""",
)
def ingest_stream(spark, sf_dir):
    tables = I.IngestTables(shared_dir(spark, "ingest"))
    queue = shared_dir(spark, "queue")
    message_texts(spark, sf_dir).write.parquet(queue)
    docs = documents(spark, sf_dir)
    docs.filter(F.col("doc_id").cast("long") % 13 == 2).select(*I.DOC).write.parquet(f"{tables.root}/tombstones")
    # the named files, each whole; one in five is not there
    inbox, number = shared_dir(spark, "inbox"), F.col("doc_id").cast("long")
    docs.filter((number % 7 == 3) & (number % 35 != 3)).select("doc_id", "text").write.partitionBy("doc_id").text(inbox)
    files = spark.read.schema("value string, doc_id string").text(inbox, wholetext=True)
    files = files.select(F.concat(F.lit("in/"), "doc_id", F.lit(".txt")).alias("path"), F.col("value").alias("text"))
    messages = spark.readStream.schema("value string").parquet(queue)
    I.start_ingest(messages, tables, shared_dir(spark, "ingest-marks"), files=files).awaitTermination()
    stored = tables.chunks(spark).select("doc_id").distinct().withColumn("__c", F.lit(1))
    vectors = tables.vectors(spark).select("doc_id").distinct().withColumn("__v", F.lit(1))
    dead = tables.dead_letters(spark).select(F.get_json_object("value", "$.docId").alias("doc_id"), F.lit(1).alias("__d")).distinct()
    return (
        docs.select("doc_id").join(stored, "doc_id", "left").join(vectors, "doc_id", "left").join(dead, "doc_id", "left")
        .select("doc_id", F.col("__c").isNotNull().alias("stored"), F.col("__v").isNotNull().alias("has_vectors"), F.col("__d").isNotNull().alias("dead"))
    )
