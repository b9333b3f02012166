"""Views of the given tables as documents, queries, chunks and tenant records.

Each view has a Spark form and an SQL form (a common table expression), so a query and
its SQL start from the same rows. Texts with headings, CJK or untidy blanks are derived
from the document texts by the same replacement on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.strings import strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Use all cores for text work when the scan has fewer splits than cores.

    One small file is one split; a large table has enough splits and is left alone.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# --- documents: one tenant, a knowledge base per language, a file per source ---


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.lit("main").alias("tenant_id"),
        F.col("lang").alias("kb_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat("source", F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("corpus://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_uri"),
        "text",
    )


DOCS = """docs AS (
  SELECT 'main' AS tenant_id, lang AS kb_id, CAST(doc_id AS VARCHAR) AS doc_id,
         source || '.txt' AS file_name,
         'corpus://' || source || '/' || CAST(doc_id AS VARCHAR) AS source_uri, text
  FROM documents)"""


# --- questions: every benchmark passage asked in every knowledge base ---


def questions(spark: SparkSession, sf_dir: str, top_k: int = 5) -> DataFrame:
    kbs = documents(spark, sf_dir).select("tenant_id", F.col("kb_id")).distinct()
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("query")
    )
    # a knowledge-base list per tenant is small; it rides on each question
    lists = kbs.groupBy("tenant_id").agg(F.sort_array(F.collect_set("kb_id")).alias("kbs"))
    return (
        items.withColumn("tenant_id", F.lit("main"))
        .join(lists, "tenant_id")
        .select("*", F.explode("kbs").alias("kb_id"))
        .select(
            F.concat_ws("@", "item_id", "kb_id").alias("query_id"),
            "tenant_id",
            "kb_id",
            "item_id",
            "query",
            F.lit(top_k).cast("long").alias("top_k"),
        )
    )


QUESTIONS = """questions AS (
  SELECT CAST(item_id AS VARCHAR) || '@' || k.kb_id AS query_id, k.tenant_id, k.kb_id,
         CAST(item_id AS VARCHAR) AS item_id, b.text AS query, CAST(5 AS BIGINT) AS top_k
  FROM benchmark b CROSS JOIN (SELECT DISTINCT tenant_id, kb_id FROM docs) k)"""


# --- line chunks: a document is a parent, its non-blank lines are the children ---


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    entries = F.concat(
        F.array(
            F.struct(
                F.lit("parent").alias("chunk_type"), F.lit(-1).alias("i"), strip("text").alias("text")
            )
        ),
        F.transform(lines, lambda x, i: F.struct(F.lit("child").alias("chunk_type"), i.alias("i"), x.alias("text"))),
    )
    rows = docs.select(
        "tenant_id", "kb_id", "doc_id", "file_name", "source_uri", F.explode(entries).alias("e")
    )
    child = F.col("e.chunk_type") == "child"
    return rows.select(
        "tenant_id",
        "kb_id",
        "doc_id",
        F.concat("doc_id", F.when(child, F.concat(F.lit("-"), F.col("e.i").cast("string"))).otherwise(F.lit("-p"))).alias("chunk_id"),
        F.col("e.chunk_type").alias("chunk_type"),
        F.concat("doc_id", F.lit("-p")).alias("parent_id"),
        F.when(child, F.col("e.i").cast("long")).alias("child_index"),
        F.greatest(F.col("e.i"), F.lit(0)).cast("long").alias("chunk_index"),
        F.col("e.text").alias("text"),
        "file_name",
        "source_uri",
        F.lit(None).cast("int").alias("page"),
        F.create_map(F.lit("doc_id"), F.col("doc_id"), F.lit("kb_id"), F.col("kb_id")).alias("metadata"),
    )


LINE_CHUNKS = r"""child_lines AS (
  SELECT tenant_id, kb_id, doc_id, file_name, source_uri,
         unnest(list_filter(list_transform(string_split(text, chr(10)),
                lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS line,
         generate_subscripts(list_filter(list_transform(string_split(text, chr(10)),
                lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 1) - 1 AS i
  FROM docs),
chunks AS (
  SELECT tenant_id, kb_id, doc_id, doc_id || '-p' AS chunk_id, 'parent' AS chunk_type,
         doc_id || '-p' AS parent_id, CAST(NULL AS BIGINT) AS child_index, CAST(0 AS BIGINT) AS chunk_index,
         regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, file_name, source_uri
  FROM docs
  UNION ALL
  SELECT tenant_id, kb_id, doc_id, doc_id || '-' || i, 'child', doc_id || '-p', CAST(i AS BIGINT), CAST(i AS BIGINT),
         line, file_name, source_uri
  FROM child_lines)"""


def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks(spark, sf_dir).filter("chunk_type = 'child'")


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- texts derived from the documents ---

CJK_FROM, CJK_TO = "etaoinshrdl", "的合同协议条款第章节"


def untidy(text):
    """Blanks, tabs, repeated newlines and NUL put into a text."""
    out = F.replace(text, F.lit(" the "), F.lit(" \t the\x0b \r "))
    out = F.replace(out, F.lit(". "), F.lit(" .\n\n\n\n "))
    return F.replace(out, F.lit(", "), F.lit(" ,\x00( "))


UNTIDY = (
    "replace(replace(replace(text, ' the ', ' ' || chr(9) || ' the' || chr(11) || ' ' || chr(13) || ' '), "
    "'. ', ' .' || chr(10) || chr(10) || chr(10) || chr(10) || ' '), ', ', ' ,' || chr(0) || '( ')"
)


def cjk(text):
    """A text whose common letters are replaced by CJK characters."""
    return F.translate(F.lower(text), CJK_FROM, CJK_TO)


CJK_SQL = f"translate(lower(text), '{CJK_FROM}', '{CJK_TO}')"

# heading marks put in front of some lines, by line number
HEADING_MARKS = ("# ", "## ", "第三章 ", "第2节 ", "第十条 ", "二、", "3.1 ", "4) ")


def headed(text):
    """Every fifth line becomes a heading, the mark cycling through all heading forms."""
    marks = F.array(*[F.lit(m) for m in HEADING_MARKS])
    lines = F.split(text, "\n")
    marked = F.transform(
        lines,
        lambda x, i: F.when(
            i % 5 == 2, F.concat(F.element_at(marks, (F.floor(i / 5) % len(HEADING_MARKS) + 1).cast("int")), x)
        ).otherwise(x),
    )
    return F.array_join(marked, "\n")


HEADED = (
    "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN "
    "[" + ", ".join(f"'{m}'" for m in HEADING_MARKS) + "]"
    f"[CAST(((i - 1) // 5) % {len(HEADING_MARKS)} + 1 AS INTEGER)] || x ELSE x END), chr(10))"
)


def passage_matches(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the document text contains the passage.

    Words strictly inside a passage are whole words of any text that contains it, in the
    same order. Five of them form a key, fewer for passages with fewer; equal keys meet and
    the containment is then checked. A passage of one or two words has no word inside: it is
    met by the three-character keys of the texts' words, or character by character.
    """
    words = F.split("text", r"[ \n]+")

    def grams(values, n, glue):
        """Keys of all ``n`` consecutive values; the one-element array splits a text once, not once a place."""
        return F.flatten(
            F.transform(
                F.array(values),
                lambda all_: F.transform(
                    F.when(F.size(all_) >= n, F.sequence(F.lit(1), F.size(all_) - n + 1)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.xxhash64(F.array_join(F.slice(all_, i, n), glue)),
                ),
            )
        )

    # inner words: the first and last may be cut
    inner = F.least(F.size("w") - 2, F.lit(5))
    keyed = passages.filter("text <> ''").withColumn("w", words).withColumn("by_words", inner > 0)
    keyed = keyed.withColumn("n", F.when(F.col("by_words"), inner).otherwise(F.least(F.length("text"), F.lit(3))))
    own = F.when(F.col("by_words"), F.array_join(F.slice("w", F.lit(2), F.col("n")), " ")).otherwise(
        F.substring(F.col("text"), F.lit(1), F.col("n"))
    )
    keys = keyed.select("item_id", F.col("text").alias("passage"), F.xxhash64(own).alias("key"))
    # at most eight kinds of keys: one to five words, one to three characters
    kinds = [tuple(r) for r in keyed.select("by_words", "n").distinct().collect()]

    def of_text(by_words, n):
        return grams(words, n, " ") if by_words else grams(F.split("text", ""), n, "")

    made = F.concat(*[of_text(*k) for k in sorted(kinds)]) if kinds else F.array().cast("array<bigint>")
    doc_keys = docs.select("doc_id", F.explode(F.array_distinct(made)).alias("key"))
    pairs = doc_keys.join(keys, "key").select("item_id", "passage", "doc_id")
    return (
        pairs.join(docs.select("doc_id", "text"), "doc_id")
        .filter(F.contains("text", "passage"))
        .select("item_id", "doc_id")
        .distinct()
    )
