"""The ingest stream: messages to chunk and vector tables, with tombstones and dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sextant.functions import ids
from sextant.functions.metadata import redact
from sextant.operators import vector_search as N
from sextant.operators.chunking import chunk_rows, index_rows
from sextant.operators.ranking import best_per_key
from sextant.operators.storage import BUCKETS, DOC, DocumentTable, _read, without_deleted
from sextant.schemas import CHUNK, INGEST_MESSAGE
from sextant.session import store
from sextant.settings import DEFAULTS, Settings

#: A chunk and its vector are one row, so neither is ever seen without the other.
INDEXED = T.StructType([*CHUNK.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
TOMBSTONE = T.StructType([T.StructField(c, T.StringType()) for c in DOC])
JOB = T.StructType(
    [
        T.StructField("job_key", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in DOC],
        T.StructField("status", T.StringType()),
        T.StructField("chunk_count", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)


def parse_messages(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid ingest jobs with their key, and the rejected messages with a reason.

    A message must be a JSON object with tenant and knowledge base, and bring its content or
    name a file; ``file_path`` is null where the content is there.
    """
    is_object = F.col(column).startswith("{") & F.get_json_object(column, "$").isNotNull()
    parsed = raw.withColumn("m", F.when(is_object, F.from_json(column, INGEST_MESSAGE))).withColumn(
        "payload_map", F.when(is_object, F.from_json(column, "map<string,string>"))
    )
    reason = (
        F.when(F.col("m").isNull(), F.lit("not a JSON object"))
        .when(F.coalesce("m.tenantId", F.lit("")) == "", F.lit("tenantId is required"))
        .when(F.coalesce("m.kbId", F.lit("")) == "", F.lit("kbId is required"))
        .when(F.col("m.content").isNull() & (F.coalesce("m.filePath", F.lit("")) == ""), F.lit("filePath or content is required."))
    )
    checked = parsed.withColumn("reason", reason)
    explicit = F.coalesce(
        *[F.nullif(F.col(f"m.{n}"), F.lit("")) for n in ("jobId", "job_id", "messageId", "message_id")], F.lit("")
    )
    digest = F.sha2(column, 256)
    named = F.coalesce(*[F.nullif(F.col(f"m.{n}"), F.lit("")) for n in ("docId", "sourceUri", "filePath")])
    valid = checked.filter(F.col("reason").isNull())
    key = ids.job_key(explicit, F.col("m.tenantId"), F.col("m.kbId"), named, digest)
    jobs = valid.select(
        key.alias("job_key"),
        F.col("m.tenantId").alias("tenant_id"),
        F.col("m.kbId").alias("kb_id"),
        F.coalesce(F.nullif("m.docId", F.lit("")), key).alias("doc_id"),
        F.col("m.content").alias("text"),
        F.when(F.col("m.content").isNull(), F.col("m.filePath")).alias("file_path"),
        F.col("m.fileName").alias("file_name"),
        F.coalesce("m.sourceUri", "m.filePath").alias("source_uri"),
        F.map_concat(
            F.create_map(F.lit("source"), F.coalesce("m.sourceUri", F.lit("inline"))),
            F.map_filter(
                F.coalesce("m.metadata", F.create_map().cast("map<string,string>")), lambda k, _v: k != "source"
            ),
        ).alias("metadata"),
        F.to_json(redact("payload_map")).alias("payload"),
        *[c for c in ("seq",) if c in raw.columns],
    )
    return jobs, checked.filter(F.col("reason").isNotNull()).select(column, "reason")


@dataclass(frozen=True)
class IngestTables:
    """Folders of one ingest: chunks with their vectors, tombstones, job records, dead letters."""

    root: str
    settings: Settings = DEFAULTS
    buckets: int = BUCKETS

    @property
    def indexed(self) -> DocumentTable:
        return DocumentTable(f"{self.root}/chunks", INDEXED, self.buckets)

    def chunks(self, spark: SparkSession) -> DataFrame:
        return self.indexed.read(spark).drop("vector")

    def vectors(self, spark: SparkSession) -> DataFrame:
        rows = self.indexed.read(spark).filter(F.col("vector").isNotNull())
        return rows.select(*DOC, "chunk_id", "vector", "metadata")

    def tombstones(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.root}/tombstones", TOMBSTONE)

    def jobs(self, spark: SparkSession) -> DataFrame:
        """The record of each job."""
        return _read(spark, f"{self.root}/jobs", JOB).drop("bucket")

    def _job_bucket(self):
        return F.pmod(F.xxhash64("job_key"), F.lit(self.buckets)).cast("int")

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.root}/dead_letters", T.StructType.fromDDL("value string, reason string"))

    def delete(self, documents: DataFrame) -> None:
        """Tombstone documents and drop their rows."""
        documents.select(*DOC).distinct().write.mode("append").parquet(f"{self.root}/tombstones")
        self.indexed.delete(documents)

    def _finished(self, spark: SparkSession, jobs: DataFrame, batch_id: int) -> DataFrame:
        """Records of other batches, from the buckets that these jobs can be in."""
        numbers = [r["b"] for r in jobs.select(self._job_bucket().alias("b")).distinct().collect()]
        return _read(spark, f"{self.root}/jobs", JOB).filter(F.col("bucket").isin(numbers) & (F.col("batch_id") != batch_id))

    def ingest(self, raw: DataFrame, batch_id: int, embedder=None, files: DataFrame | None = None) -> None:
        """One micro-batch of messages; running it again gives the same tables.

        Finished jobs are skipped unless this batch finished them (a replay). Messages that name a
        file take its text from ``files`` (path, text), by a join; those whose file is not
        there are dead letters. Tombstones are read before the work and again right before the
        rows are written. The job records, which mark a job finished, come last.
        """
        spark = raw.sparkSession
        # the messages' order: theirs if they bring it, else their place in the source
        numbered = raw if "seq" in raw.columns else raw.withColumn("seq", F.monotonically_increasing_id())
        jobs, rejected = parse_messages(store(numbered, "ingest-batch"))
        first = store(best_per_key(jobs, ["job_key"], [F.col("seq")]), "ingest-messages")
        if files is None:
            files = spark.createDataFrame([], "path string, text string")
        named = first.join(files.select(F.col("path").alias("file_path"), F.col("text").alias("file_text")), "file_path", "left")
        named = store(named.withColumn("text", F.coalesce("text", "file_text")).drop("file_text"), "ingest-texts")
        lost = named.filter(F.col("text").isNull()).select(
            F.col("payload").alias("value"), F.concat(F.lit("file not found: "), "file_path").alias("reason")
        )
        done = store(self._finished(spark, first, batch_id), "finished-jobs")
        found = named.filter(F.col("text").isNotNull()).drop("file_path")
        open_jobs = without_deleted(found.join(done.select("job_key"), "job_key", "left_anti"), self.tombstones(spark))
        # one document per batch: its last job wins
        latest = store(best_per_key(open_jobs, DOC, [-F.col("seq")]), "ingest-jobs")
        rows = store(chunk_rows(latest, self.settings), "ingest-chunks")
        vectors = N.vector_rows(index_rows(rows), embedder, self.settings.vector_dim).select(*DOC, "chunk_id", "vector")
        indexed = store(rows.join(vectors, [*DOC, "chunk_id"], "left"), "ingest-indexed")
        # the second look at the tombstones comes after the work
        live = without_deleted(indexed, self.tombstones(spark))
        self.indexed.replace(latest, live)
        rejected.unionByName(lost).write.mode("overwrite").parquet(f"{self.root}/dead_letters/batch_id={batch_id}")
        counts = live.groupBy(*DOC).agg(F.count("*").alias("chunk_count"))
        records = open_jobs.join(counts, DOC, "left").select(
            "job_key", *DOC, F.lit("succeeded").alias("status"),
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            F.lit(None).cast("string").alias("error_message"), "payload", F.lit(batch_id).cast("long").alias("batch_id"),
        ).withColumn("bucket", self._job_bucket())
        both = store(done.select(*JOB.fieldNames()).unionByName(records.select(*JOB.fieldNames())), "job-records")
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/jobs")


def start_ingest(messages: DataFrame, tables: IngestTables, checkpoint: str, embedder=None, files: DataFrame | None = None) -> StreamingQuery:
    """Run the ingest over a stream of message texts until the source is drained."""
    return (
        messages.writeStream.foreachBatch(lambda batch, batch_id: tables.ingest(batch, batch_id, embedder, files))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
