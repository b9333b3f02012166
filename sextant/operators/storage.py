"""Chunk and vector tables: replacing, deleting and listing the rows of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.operators.ranking import best_per_key, top_per_group
from sextant.session import store

DOC = ["tenant_id", "kb_id", "doc_id"]


def replace_documents(existing: DataFrame, new: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Table after replacing all rows of the touched documents.

    ``replaced`` names the documents when some of them have no new row. A chunk id that
    another document already holds is overwritten.
    """
    touched = (new if replaced is None else replaced).select(*DOC).distinct()
    kept = existing.join(touched, DOC, "left_anti").join(new.select("chunk_id").distinct(), "chunk_id", "left_anti")
    unique = best_per_key(new, ["chunk_id"], [F.col("tenant_id"), F.col("kb_id"), F.col("doc_id")])
    return kept.select(*existing.columns).unionByName(unique.select(*existing.columns))


def delete_documents(chunks: DataFrame, vectors: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk and vector tables without the doomed documents, and the rows removed per document.

    Vectors go only where chunk rows were removed.
    """
    gone = doomed.select(*DOC).distinct()
    counts = gone.join(chunks.groupBy(*DOC).agg(F.count("*").alias("n")), DOC, "left").select(
        *DOC, F.coalesce("n", F.lit(0)).alias("deleted_chunks")
    )
    with_rows = counts.filter("deleted_chunks > 0").select(*DOC)
    return chunks.join(gone, DOC, "left_anti"), vectors.join(with_rows, DOC, "left_anti"), counts


def add_tombstones(tombstones: DataFrame, doomed: DataFrame, at) -> DataFrame:
    """Tombstones with the doomed documents added; a repeated one gets the new time."""
    new = doomed.select(*DOC).distinct().withColumn("deleted_at", at)
    return tombstones.join(new, DOC, "left_anti").select(*DOC, "deleted_at").unionByName(new)


def without_deleted(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select(*DOC), DOC, "left_anti")


def list_chunks(chunks: DataFrame, tenant_id: str, kb_id: str, limit: int, condition=None) -> DataFrame:
    """Chunks of one scope with an optional filter, by id, at most ``limit``."""
    rows = chunks.filter((F.col("tenant_id") == tenant_id) & (F.col("kb_id") == kb_id))
    if condition is not None:
        rows = rows.filter(condition)
    return rows.orderBy("chunk_id").limit(limit)


def list_chunks_per_scope(chunks: DataFrame, limit: int, condition=None) -> DataFrame:
    """The same listing for every scope at once."""
    rows = chunks if condition is None else chunks.filter(condition)
    return top_per_group(rows, ["tenant_id", "kb_id"], [F.col("chunk_id")], limit)


#: Buckets of the documents of a scope; fixed for the life of a table.
BUCKETS = 16


@dataclass(frozen=True)
class DocumentTable:
    """Rows of documents under ``path``, partitioned by scope and a bucket of the document.

    A change reads the partitions of its documents only, and Spark's dynamic partition overwrite
    puts new ones in their place; the others are not touched. The same change again gives the
    same table. Each partition keeps a row without a document, so that one that loses all its
    documents is overwritten too.
    """

    path: str
    schema: T.StructType
    buckets: int = BUCKETS

    @property
    def _stored(self) -> T.StructType:
        # partition columns come last, as they are read
        rest = [f for f in self.schema.fields if f.name not in DOC[:2]]
        scope = [T.StructField(c, T.StringType()) for c in DOC[:2]]
        return T.StructType([*rest, *scope, T.StructField("bucket", T.IntegerType())])

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def read(self, spark: SparkSession) -> DataFrame:
        rows = _read(spark, self.path, self._stored).filter(F.col("doc_id").isNotNull())
        return rows.select(*self.schema.fieldNames())

    def replace(self, documents: DataFrame, rows: DataFrame) -> None:
        """Put ``rows`` in the place of all rows of ``documents`` (scope, doc_id)."""
        spark, part = rows.sparkSession, [*DOC[:2], "bucket"]
        touched = store(self._placed(documents.select(*DOC).distinct()), "touched-documents")
        parts = touched.select(*part).distinct()
        # at most as many numbers as there are buckets; the scope prunes by the join
        numbers = [r["bucket"] for r in parts.select("bucket").distinct().collect()]
        before = _read(spark, self.path, self._stored).filter(F.col("bucket").isin(numbers) & F.col("doc_id").isNotNull())
        kept = before.join(parts, part, "left_semi").join(touched.select(*DOC), DOC, "left_anti")
        names = self._stored.fieldNames()
        marks = parts.select(*[F.col(f.name) if f.name in part else F.lit(None).cast(f.dataType).alias(f.name) for f in self._stored.fields])
        merged = kept.select(*names).unionByName(self._placed(rows).select(*names)).unionByName(marks)
        # written aside first: a table is not overwritten while it is read
        merged = store(merged, "merged-documents")
        out = merged.repartition(*part, F.pmod(F.xxhash64("doc_id"), F.lit(64 * self.buckets)))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(self.path)

    def delete(self, documents: DataFrame) -> None:
        self.replace(documents, documents.sparkSession.createDataFrame([], self.schema))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
