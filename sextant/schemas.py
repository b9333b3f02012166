"""Explicit schemas of the tables and messages the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

DOCUMENT = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("kb_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("source_uri", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("metadata", STRING_MAP),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("kb_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("parent_index", T.LongType()),
        T.StructField("child_index", T.LongType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("source_uri", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("metadata", STRING_MAP),
    ]
)

# Ingest message: camelCase on the wire.
INGEST_MESSAGE = T.StructType(
    [
        T.StructField("tenantId", T.StringType()),
        T.StructField("kbId", T.StringType()),
        T.StructField("docId", T.StringType()),
        T.StructField("filePath", T.StringType()),
        T.StructField("fileName", T.StringType()),
        T.StructField("sourceUri", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embeddingProvider", T.StringType()),
        T.StructField("embeddingModel", T.StringType()),
        T.StructField("embeddingBaseUrl", T.StringType()),
        T.StructField("embeddingApiKey", T.StringType()),
        T.StructField("embeddingTruncate", T.StringType()),
        T.StructField("metadata", STRING_MAP),
        T.StructField("jobId", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("messageId", T.StringType()),
        T.StructField("message_id", T.StringType()),
    ]
)

HIT = T.StructType(
    [
        T.StructField("chunkId", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("vectorScore", T.DoubleType()),
        T.StructField("vector_score", T.DoubleType()),
        T.StructField("keywordScore", T.DoubleType()),
        T.StructField("keyword_score", T.DoubleType()),
        T.StructField(
            "citation",
            T.StructType(
                [
                    T.StructField("docId", T.StringType()),
                    T.StructField("doc_id", T.StringType()),
                    T.StructField("chunkId", T.StringType()),
                    T.StructField("chunk_id", T.StringType()),
                    T.StructField("fileName", T.StringType()),
                    T.StructField("file_name", T.StringType()),
                    T.StructField("sourceUri", T.StringType()),
                    T.StructField("page", T.IntegerType()),
                ]
            ),
        ),
        T.StructField("metadata", STRING_MAP),
    ]
)

RESULT_LINE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("queryId", T.StringType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("hits", T.ArrayType(HIT)),
    ]
)

_RELEVANT = T.StructType(
    [
        T.StructField(name, T.ArrayType(T.StringType()))
        for name in ("docIds", "doc_ids", "chunkIds", "chunk_ids", "parentIds", "parent_ids")
    ]
)

GOLD_LINE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("tenantId", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("kbId", T.StringType()),
        T.StructField("kb_id", T.StringType()),
        T.StructField("answerable", T.BooleanType()),
        T.StructField("relevant", _RELEVANT),
        T.StructField("metadataFilter", STRING_MAP),
        T.StructField("metadata_filter", STRING_MAP),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("notes", T.StringType()),
    ]
)
