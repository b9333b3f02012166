"""File sources and report sinks: files are written from the given tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog import quality as Q
from sextant.catalog.base import table, with_ctes
from sextant.catalog.registry import query
from sextant.operators import evaluation as E
from sextant.schemas import GOLD_LINE
from sextant.session import shared_dir
from sextant.sources import files as S


def _written(rows, purpose: str) -> str:
    """A text file for each source, its lines (source, doc_id, k, line) in order."""
    path = shared_dir(rows.sparkSession, purpose)
    ordered = rows.repartition("source").sortWithinPartitions("source", "doc_id", "k")
    ordered.select("source", F.col("line").alias("value")).write.partitionBy("source").text(path)
    return path


def _source():
    return F.regexp_extract("source", "/source=([^/]*)/", 1).alias("source")


@query(
    "text_files", "SRC2",
    """SELECT source, count(*) AS documents, length(string_agg(text, chr(10) ORDER BY doc_id)) + 1 AS n_chars,
      md5(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY source""",
)
def text_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.lit(0).alias("k"), F.col("text").alias("line"))
    read = S.read_texts(spark, _written(docs, "texts"))
    each = read.select(F.col("source_uri").alias("source"), "text").select(_source(), "text")
    counts = docs.groupBy("source").agg(F.count("*").alias("documents"))
    return each.join(counts, "source").select(
        "source", "documents", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")
    )


@query(
    "csv_files", "SRC3",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CASE WHEN lang IN ('de', 'en') THEN string_split(text, chr(10))[1] END AS "first",
      CASE WHEN lang IN ('fr', 'es') THEN string_split(text, chr(10))[1] END AS premier, CASE WHEN lang = 'fr' THEN '00' || n_chars END AS size
    FROM documents WHERE string_split(text, chr(10))[1] <> ''""",
)
def csv_files(spark, sf_dir):
    """Two encodings, columns that differ from file to file, values that only look like numbers."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = table(spark, sf_dir, "documents").withColumn("line", F.split("text", "\n")[0]).filter("line <> ''")
    path = shared_dir(spark, "csv")
    size = F.concat(F.lit("00"), F.col("n_chars").cast("string")).alias("size")
    for lang, encoding, columns in (
        ("de", "GB18030", ["lang", F.col("line").alias("first"), "doc_id"]),
        ("en", "UTF-8", ["doc_id", "lang", F.col("line").alias("first")]),
        ("es", "GB18030", ["doc_id", F.col("line").alias("premier"), "lang"]),
        ("fr", "UTF-8", [size, "doc_id", "lang", F.col("line").alias("premier")]),
    ):
        out = rows.filter(F.col("lang") == lang).select(*columns)
        options = {"header": True, "encoding": encoding, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        out.write.options(**options).mode("append").csv(path)
    return S.read_csv(spark, path).select("doc_id", "lang", "first", "premier", "size")


def _gold_lines(spark, sf_dir):
    """Documents as gold items: comments and blank lines between them, two spellings of the keys, some incomplete."""
    n = F.col("doc_id")
    camel = F.to_json(F.struct(
        n.cast("string").alias("id"), F.when(n % 11 != 4, F.col("text")).alias("query"), F.lit("t").alias("tenantId"), F.col("lang").alias("kbId"),
        F.when(n % 3 == 0, F.lit(False)).alias("answerable"), F.struct(F.array(F.lit("a"), n.cast("string"), F.lit("a")).alias("docIds")).alias("relevant"),
    ))
    snake = F.to_json(F.struct(
        n.cast("string").alias("id"), F.col("text").alias("query"), F.when(n % 13 != 5, F.lit("u")).alias("tenant_id"), F.col("lang").alias("kb_id"),
        F.struct(F.array(F.lit("b")).alias("doc_ids")).alias("relevant"), F.array(F.col("source")).alias("tags"),
    ))
    own = F.when(n % 17 == 6, F.lit("not an object")).when(n % 2 == 0, camel).otherwise(snake)
    entries = F.array(
        F.when(n % 5 == 0, F.concat(F.lit("# item "), n.cast("string"))), F.when(n % 7 == 0, F.lit("  \t")), own
    )
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(entries).alias("k", "line"))
    return rows.filter("line IS NOT NULL")


_GOLD = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) AS line_no FROM (
    SELECT source, doc_id, 0 AS k, lang, text FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT source, doc_id, 1, lang, text FROM documents WHERE doc_id % 7 = 0
    UNION ALL SELECT source, doc_id, 2, lang, text FROM documents)),
items AS (
  SELECT *, doc_id % 17 = 6 AS broken, doc_id % 17 = 6 OR (doc_id % 2 = 0 AND (doc_id % 11 = 4 OR text = '')) OR
    (doc_id % 2 = 1 AND (doc_id % 13 = 5 OR text = '')) AS rejected FROM placed WHERE k = 2)"""


@query(
    "json_lines", "SRC4",
    with_ctes(_GOLD, select="""SELECT source, line_no, NOT broken AS is_object, CASE WHEN NOT broken THEN CAST(doc_id AS VARCHAR) END AS id,
      CASE WHEN NOT broken AND NOT (doc_id % 2 = 0 AND doc_id % 11 = 4) THEN length(text) ELSE -1 END AS n_chars FROM items"""),
)
def json_lines(spark, sf_dir):
    rows = S.read_json_lines(spark, _written(_gold_lines(spark, sf_dir), "json-lines"), GOLD_LINE)
    return rows.select(
        _source(), "line_no", F.col("row").isNotNull().alias("is_object"), F.col("row.id").alias("id"),
        F.coalesce(F.length("row.query").cast("long"), F.lit(-1)).alias("n_chars"),
    )


@query(
    "gold_set", "SRC5",
    with_ctes(_GOLD, select="""SELECT CASE WHEN rejected THEN source || ':' || line_no ELSE CAST(doc_id AS VARCHAR) END AS item, rejected,
      CASE WHEN NOT rejected THEN CASE WHEN doc_id % 2 = 0 THEN 't' ELSE 'u' END END AS tenant_id, CASE WHEN NOT rejected THEN lang END AS kb_id,
      NOT rejected AND (doc_id % 2 = 1 OR doc_id % 3 <> 0) AS answerable,
      CASE WHEN NOT rejected THEN CASE WHEN doc_id % 2 = 0 THEN 'a,' || doc_id ELSE 'b' END END AS doc_ids,
      CASE WHEN NOT rejected THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END END AS tags FROM items"""),
)
def gold_set(spark, sf_dir):
    good, bad = S.read_gold(spark, _written(_gold_lines(spark, sf_dir), "gold"))
    kept = good.select(
        F.col("query_id").alias("item"), F.lit(False).alias("rejected"), "tenant_id", "kb_id", "answerable",
        F.array_join("doc_ids", ",").alias("doc_ids"), F.array_join("tags", ",").alias("tags"),
    )
    place = F.concat_ws(":", F.regexp_extract("source", "/source=([^/]*)/", 1), F.col("line_no").cast("string"))
    return kept.unionByName(bad.select(place.alias("item"), F.lit(True).alias("rejected"), F.lit(False).alias("answerable")), allowMissingColumns=True)


@query(
    "result_set", "SRC6",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no FROM documents),
    good AS (SELECT *, source || '-' || (doc_id % 7) AS query_id FROM r WHERE doc_id % 13 <> 0),
    last AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line_no DESC) AS back FROM good)
    SELECT query_id, FALSE AS rejected, CASE WHEN doc_id % 4 = 1 THEN 'error ' || doc_id ELSE '' END AS error, CAST(doc_id % 3 AS BIGINT) AS n_hits,
      CASE WHEN doc_id % 3 > 0 THEN doc_id || '-0' END AS first_chunk FROM last WHERE back = 1
    UNION ALL SELECT source || ':' || line_no, TRUE, NULL, 0, NULL FROM r WHERE doc_id % 13 = 0""",
)
def result_set(spark, sf_dir):
    """An id comes many times in a file, under three names; its last line counts."""
    n = F.col("doc_id")
    name = F.concat_ws("-", "source", (n % 7).cast("string"))
    ids = [F.when((n % 13 != 0) & (n % 3 == k), name).alias(a) for k, a in enumerate(("id", "queryId", "query_id"))]
    hits = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1)), 1, (n % 3).cast("int")),
        lambda i: F.struct(F.concat_ws("-", n.cast("string"), i.cast("string")).alias("chunkId"), (F.lit(1.0) / (i + 1)).alias("score")),
    )
    error = F.when(n % 4 == 1, F.concat(F.lit("error "), n.cast("string"))).alias("error")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.lit(0).alias("k"), F.to_json(F.struct(*ids, hits.alias("hits"), error)).alias("line"))
    last, bad = S.read_results(spark, _written(rows, "results"))
    kept = last.select(
        "query_id", F.lit(False).alias("rejected"), "error", F.size("hits").cast("long").alias("n_hits"),
        F.get("hits", F.lit(0))["chunkId"].alias("first_chunk"),
    )
    place = F.concat_ws(":", F.regexp_extract("source", "/source=([^/]*)/", 1), F.col("line_no").cast("string"))
    return kept.unionByName(bad.select(place.alias("query_id"), F.lit(True).alias("rejected"), F.lit(0).cast("long").alias("n_hits")), allowMissingColumns=True)


@query(
    "evaluation_report", "SNK4",
    with_ctes(
        *Q._CTES, Q._METRICS, "shown AS (SELECT query_id, count(*) AS n FROM results WHERE rank <= 10 GROUP BY query_id)",
        select=f"""SELECT m.query_id, answerable, hit_count, {Q._f('r10')} AS recall, array_to_string(tags, ',') AS tags, error,
      coalesce(n, 0) AS n_shown, (SELECT count(*) FROM metrics) AS total
      FROM metrics m LEFT JOIN shown s ON s.query_id = m.query_id
      WHERE (answerable AND r10 < 1) OR (NOT answerable AND f10) OR error <> ''""",
    ),
)
def evaluation_report(spark, sf_dir):
    """The written summary, failure table and failure lines, read again."""
    path = shared_dir(spark, "report")
    E.write_report(Q.metrics(spark, sf_dir), Q._answered(spark, sf_dir), Q.KS, path)
    listed = spark.read.schema("query_id string, query string, answerable boolean, hit_count long, matched_rank long, recall double, tags string, error string")
    failures = listed.options(header=True, multiLine=True).csv(f"{path}/failures_csv")
    lines = spark.read.schema("query_id string, top_hits array<struct<rank:int>>").json(f"{path}/failures_jsonl")
    total = spark.read.schema("total long").json(f"{path}/summary").first()["total"]
    return failures.join(lines, "query_id").select(
        "query_id", "answerable", "hit_count", F.round("recall", 6).alias("recall"), F.coalesce("tags", F.lit("")).alias("tags"),
        F.coalesce("error", F.lit("")).alias("error"), F.greatest(F.size(F.coalesce("top_hits", F.array())), F.lit(0)).cast("long").alias("n_shown"),
        F.lit(total).alias("total"),
    )
