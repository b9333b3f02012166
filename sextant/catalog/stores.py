"""Scoped listings, metadata filters and maps, and the table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog.base import DOCS, LINE_CHUNKS, line_chunks, table, with_ctes
from sextant.catalog.registry import query
from sextant.catalog.searches import embedding_rows
from sextant.functions import ids
from sextant.functions import metadata as MD
from sextant.operators import storage as S
from sextant.operators.chunking import index_rows


@query(
    "list_scope_chunks", "SRC7 FLT1",
    with_ctes(
        DOCS, LINE_CHUNKS,
        select="""SELECT kb_id, chunk_id FROM (
      SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY chunk_id) AS rn FROM chunks WHERE chunk_type = 'child' AND file_name = 'src3.txt') WHERE rn <= 40""",
    ),
)
def list_scope_chunks(spark, sf_dir):
    rows = S.list_chunks_per_scope(line_chunks(spark, sf_dir), 40, MD.text_filter({"chunk_type": "child"}) & (F.col("file_name") == "src3.txt"))
    return rows.select("kb_id", "chunk_id")


def _tagged(spark, sf_dir):
    """Chunks whose metadata holds a line length, a flag and a text."""
    rows = line_chunks(spark, sf_dir)
    extra = F.create_map(
        F.lit("size"), F.length("text").cast("string"), F.lit("short"), (F.length("text") < 80).cast("string"), F.lit("file"), F.col("file_name")
    )
    return rows.withColumn("metadata", F.map_concat("metadata", extra))


@query(
    "text_metadata_filter", "FLT2",
    with_ctes(
        DOCS, LINE_CHUNKS,
        select="SELECT chunk_id FROM chunks WHERE chunk_type = 'child' AND length(text) = 60 AND length(text) < 80 AND kb_id = 'en'",
    ),
)
def text_metadata_filter(spark, sf_dir):
    wanted = {"chunk_type": "child", "size": 60, "short": True, "kb_id": "en", "skipped": None, "listed": [1, 2]}
    return _tagged(spark, sf_dir).filter(MD.text_filter(wanted)).select("chunk_id")


@query(
    "typed_metadata_filter", "FLT3",
    with_ctes(DOCS, LINE_CHUNKS, select="SELECT chunk_id FROM chunks WHERE length(text) = 60 AND length(text) < 80 AND file_name = 'src2.txt'"),
)
def typed_metadata_filter(spark, sf_dir):
    wanted = {"size": 60, "short": True, "file": "src2.txt"}
    return _tagged(spark, sf_dir).filter(
        MD.typed_filter(wanted, types={"size": "int", "short": "boolean"})
    ).select("chunk_id")


@query(
    "parent_filter", "FLT4",
    with_ctes(DOCS, LINE_CHUNKS, select="SELECT chunk_id FROM chunks WHERE chunk_type = 'parent' AND kb_id = 'de'"),
)
def parent_filter(spark, sf_dir):
    wanted = MD.without_chunk_type({"chunk_type": "child", "kb_id": "de"})
    return _tagged(spark, sf_dir).filter((F.col("chunk_type") == "parent") & MD.text_filter(wanted)).select("chunk_id")


@query(
    "metadata_defaults", "PRJ1",
    with_ctes(
        DOCS, LINE_CHUNKS,
        select="SELECT chunk_id, 'chunk_index=' || chunk_index || ',doc_id=' || doc_id || ',file_name=' || file_name || ',kb_id=' || kb_id AS metadata FROM chunks",
    ),
)
def metadata_defaults(spark, sf_dir):
    rows = line_chunks(spark, sf_dir)
    filled = MD.with_defaults(
        "metadata", {"doc_id": F.lit("never used"), "file_name": F.col("file_name"), "chunk_index": F.col("chunk_index")}
    )
    return rows.select("chunk_id", _pairs(filled).alias("metadata"))


def _pairs(column):
    entries = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), ",")


_PROPS = "CASE event_type WHEN 'error' THEN 'secret' || event_id WHEN 'view' THEN '' END"


@query(
    "sanitize_metadata", "PRJ2",
    f"""SELECT event_id, CASE WHEN ({_PROPS}) IS NULL THEN '' ELSE 'apiKey=' || ({_PROPS}) || ',' END
      || 'kind=' || event_type || ',user=' || user_id AS metadata FROM events""",
)
def sanitize_metadata(spark, sf_dir):
    return _payloads(spark, sf_dir).select("event_id", _pairs(MD.sanitize("payload")).alias("metadata"))


def _payloads(spark, sf_dir):
    kind = F.col("event_type")
    secret = F.when(kind == "error", F.concat(F.lit("secret"), F.col("event_id").cast("string"))).when(kind == "view", F.lit(""))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.create_map(F.lit("apiKey"), secret, F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), kind).alias("payload"),
    )


@query(
    "redact_secrets", "PRJ5",
    """SELECT event_id, CASE event_type WHEN 'error' THEN '[configured]' WHEN 'view' THEN '' ELSE '<none>' END AS api_key,
      CAST(user_id AS VARCHAR) AS user_text FROM events""",
)
def redact_secrets(spark, sf_dir):
    hidden = _payloads(spark, sf_dir).withColumn("p", MD.redact("payload"))
    return hidden.select(
        "event_id", F.coalesce(F.col("p")["apiKey"], F.lit("<none>")).alias("api_key"), F.col("p")["user"].alias("user_text")
    )


@query(
    "job_keys", "STR2",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'job:' || sha256('m' || user_id)
      ELSE 'doc:' || sha256('t:' || (user_id % 5) || ':' || CASE WHEN event_type = 'click' THEN 'd' || user_id ELSE sha256(props) END) END AS job_key FROM events""",
)
def job_keys(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    explicit = F.when(kind.isin("error", "view"), F.concat(F.lit("m"), user)).when(kind == "signup", F.lit(""))
    doc = F.when(kind == "click", F.concat(F.lit("d"), user))
    key = ids.job_key(explicit, F.lit("t"), (F.col("user_id") % 5).cast("string"), doc, F.sha2("props", 256))
    return table(spark, sf_dir, "events").select("event_id", key.alias("job_key"))


# --- table operations on line chunks: source src3 is re-ingested without its short lines ---


@query(
    "replace_documents", "SNK1",
    with_ctes(
        DOCS, LINE_CHUNKS,
        select="""SELECT chunk_id, CASE WHEN file_name = 'src3.txt' THEN upper(translate(text, 'éèêçöüäßíóñ', '')) ELSE text END AS text
      FROM chunks WHERE file_name <> 'src3.txt' OR length(text) >= 40""",
    ),
)
def replace_documents(spark, sf_dir):
    rows = line_chunks(spark, sf_dir)
    again = rows.filter("file_name = 'src3.txt'")
    new = again.filter(F.length("text") >= 40).withColumn("text", F.upper(F.translate("text", "éèêçöüäßíóñ", "")))
    return S.replace_documents(rows, new, again).select("chunk_id", "text")


@query(
    "replace_vectors", "SNK2 VEC5",
    """SELECT vec_id, label, round(CASE WHEN label = 4 THEN 2 * CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END, 6) AS first_value
      FROM embeddings WHERE label <> 4 OR vec_id % 2 = 0""",
)
def replace_vectors(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    again = rows.filter("doc_id = '4'")
    new = again.filter(F.col("chunk_id").cast("long") % 2 == 0).withColumn("vector", F.transform("vector", lambda x: x * 2))
    return S.replace_documents(rows, new, again).select(
        F.col("chunk_id").cast("long").alias("vec_id"), F.col("doc_id").cast("int").alias("label"),
        F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"),
    )


@query(
    "delete_documents", "SNK3 VEC5",
    with_ctes(
        DOCS, LINE_CHUNKS,
        "doomed AS (SELECT doc_id FROM docs WHERE file_name = 'src5.txt' UNION ALL SELECT 'missing')",
        select="""SELECT d.doc_id, count(c.chunk_id) AS deleted_chunks, (SELECT count(*) FROM chunks WHERE file_name <> 'src5.txt') AS chunks_left
      FROM doomed d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
    ),
)
def delete_documents(spark, sf_dir):
    rows = line_chunks(spark, sf_dir)
    doomed = rows.filter("file_name = 'src5.txt'").select(*S.DOC).unionByName(
        rows.groupBy("tenant_id").agg(F.min("kb_id").alias("kb_id")).withColumn("doc_id", F.lit("missing"))
    )
    left, _, counts = S.delete_documents(rows, rows.select(*S.DOC, "chunk_id"), doomed)
    total = left.groupBy("tenant_id").agg(F.count("*").alias("chunks_left"))
    return counts.join(total, "tenant_id").select("doc_id", "deleted_chunks", "chunks_left")


@query(
    "tombstoned_documents", "STR5",
    with_ctes(
        DOCS, LINE_CHUNKS,
        select="SELECT chunk_id FROM chunks WHERE chunk_type = 'child' AND file_name NOT IN ('src1.txt', 'src4.txt')",
    ),
)
def tombstoned_documents(spark, sf_dir):
    rows = line_chunks(spark, sf_dir)
    first = rows.filter("file_name = 'src1.txt'").select(*S.DOC).distinct().withColumn("deleted_at", F.lit(1))
    stones = S.add_tombstones(first, rows.filter("file_name IN ('src1.txt', 'src4.txt')"), F.lit(2))
    return S.without_deleted(rows, stones).filter("chunk_type = 'child'").select("chunk_id")


@query(
    "index_rows", "CHK14",
    with_ctes(
        DOCS, LINE_CHUNKS,
        "cut AS (SELECT * FROM chunks WHERE chunk_type = 'parent' OR length(text) >= 200)",
        select="""SELECT chunk_id FROM cut c WHERE chunk_type = 'child' OR NOT EXISTS (
      SELECT 1 FROM cut k WHERE k.doc_id = c.doc_id AND k.chunk_type = 'child')""",
    ),
)
def indexed_rows(spark, sf_dir):
    rows = line_chunks(spark, sf_dir).filter("chunk_type = 'parent' OR length(text) >= 200")
    return index_rows(rows).select("chunk_id")
