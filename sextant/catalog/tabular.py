"""Rows to documents and recognised pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog.base import table
from sextant.catalog.registry import query
from sextant.catalog.texts import _line_rules, clean_sql
from sextant.operators import pages as P
from sextant.operators import tables as T


def _dirty_parts(spark, sf_dir):
    """Parts with blank and infinite cells, blank rows, an empty column and odd names."""
    part = table(spark, sf_dir, "part")
    gone = F.col("p_partkey") % 7 == 3
    return part.select(
        F.lit("parts").alias("source"),
        F.col("p_partkey").alias("position"),
        F.when(gone, F.lit(None)).otherwise(F.col("p_name")).alias("name"),
        F.when(gone | (F.col("p_size") < 10), F.lit(" \t ")).otherwise(F.concat(F.col("p_brand"), F.lit(" \t x"))).alias("brand"),
        F.lit("  ").alias("empty"),
        F.when(~gone & (F.col("p_size") > 20), F.col("p_type")).alias("None"),
        F.when(gone | (F.col("p_size") > 40), F.lit(float("inf"))).otherwise(F.col("p_size").cast("double")).alias("size"),
    )


_DIRTY = f"""dirty AS (
  SELECT p_partkey AS position,
    CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE p_name END AS name,
    CASE WHEN p_partkey % 7 = 3 OR p_size < 10 THEN NULL ELSE {clean_sql("p_brand || ' ' || chr(9) || ' x'")} END AS brand,
    CASE WHEN p_partkey % 7 <> 3 AND p_size > 20 THEN p_type END AS column_3,
    CASE WHEN p_partkey % 7 = 3 OR p_size > 40 THEN NULL ELSE CAST(p_size AS VARCHAR) || '.0' END AS size
  FROM part),
kept AS (SELECT * FROM dirty WHERE coalesce(name, brand, column_3, size) IS NOT NULL)"""


@query(
    "clean_table_cells",
    "TAB1 TAB2 TAB3",
    f"WITH {_DIRTY} SELECT position, coalesce(name, '') AS name, coalesce(brand, '') AS brand, "
    "coalesce(column_3, '') AS column_3, coalesce(size, '') AS size FROM kept",
)
def clean_table_cells(spark, sf_dir):
    return T.clean_table(_dirty_parts(spark, sf_dir), keep=["source", "position"]).drop("source")


@query(
    "rows_to_documents",
    "TAB4",
    f"""WITH {_DIRTY} SELECT position, row_number() OVER (ORDER BY position) AS row,
      concat_ws(chr(10), 'name: ' || name, 'brand: ' || brand, 'column_3: ' || column_3, 'size: ' || size) AS text
      FROM kept""",
)
def rows_to_documents(spark, sf_dir):
    cleaned = T.clean_table(_dirty_parts(spark, sf_dir), keep=["source", "position"])
    return T.rows_to_documents(cleaned).select("position", "row", "text")


def _recognised(spark, sf_dir):
    """Document lines as recognised lines: thirty to a page, every third line read twice."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    once = lines.select(
        "doc_id",
        (F.floor(F.col("i") / 30) + 1).cast("int").alias("page"),
        (F.col("i") * 2).cast("long").alias("line_no"),
        "text",
        ((F.length("text") * 7 + F.col("i") * 13) % 100 / 100.0).cast("double").alias("score"),
    )
    again = once.filter(F.col("line_no") % 3 == 0).select(
        "doc_id", "page", (F.col("line_no") + 1).alias("line_no"),
        F.translate("text", "ae", "AE").alias("text"), F.lit(0.9).cast("double").alias("score"),
    )
    return once.unionByName(again)


_RECOGNISED = """raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
once AS (
  SELECT doc_id, CAST(i // 30 + 1 AS INTEGER) AS page, CAST(i * 2 AS BIGINT) AS line_no, text,
         CAST((length(text) * 7 + i * 13) % 100 AS DOUBLE) / 100.0 AS score FROM raw),
recognised AS (
  SELECT * FROM once
  UNION ALL SELECT doc_id, page, line_no + 1, translate(text, 'ae', 'AE'), CAST(0.9 AS DOUBLE) FROM once
  WHERE line_no % 3 = 0)"""

_READINGS = f"""good AS (
  SELECT doc_id, page, line_no, {clean_sql('text')} AS text, score,
         lower(regexp_replace({clean_sql('text')}, '\\s+', '', 'g')) AS k
  FROM recognised WHERE score >= 0.35),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, k ORDER BY line_no) AS rn FROM good WHERE text <> ''),
readings AS (
  SELECT doc_id, page, string_agg({_line_rules('text')}, chr(10) ORDER BY line_no) AS text,
         avg(score) AS avg_confidence, min(score) AS min_confidence, count(*) AS line_count,
         avg(score) < 0.55 AS low_confidence, count(*) >= 24 AS complex_layout
  FROM firsts WHERE rn = 1 GROUP BY doc_id, page)"""


@query(
    "page_readings",
    "OCR1",
    f"""WITH {_RECOGNISED}, {_READINGS}
    SELECT doc_id, page, text, round(avg_confidence, 6) AS avg_confidence, round(min_confidence, 6) AS min_confidence,
           line_count, low_confidence, complex_layout FROM readings""",
)
def page_readings(spark, sf_dir):
    return (
        P.page_readings(_recognised(spark, sf_dir))
        .withColumn("avg_confidence", F.round("avg_confidence", 6))
        .withColumn("min_confidence", F.round("min_confidence", 6))
    )


def _second(spark, sf_dir):
    """A second reading of the odd pages: their lines of at most 60 characters."""
    return (
        _recognised(spark, sf_dir)
        .filter((F.col("page") % 2 == 1) & (F.length("text") <= 60) & (F.col("line_no") % 2 == 0))
        .groupBy("doc_id", "page")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n"
            ).alias("second_text")
        )
    )


_SECOND = f"""second_lines AS (
  SELECT doc_id, page, line_no, {_line_rules('text')} AS line FROM once
  WHERE page % 2 = 1 AND length(text) <= 60),
second_keys AS (
  SELECT *, lower(regexp_replace(line, '\\s+', '', 'g')) AS k FROM second_lines WHERE line <> ''),
second_marked AS (
  SELECT *, lag(k) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS before FROM second_keys),
second AS (
  SELECT doc_id, page, left(string_agg(line, chr(10) ORDER BY line_no), 8000) AS other
  FROM second_marked WHERE before IS NULL OR before <> k GROUP BY doc_id, page),
both_pages AS (
  SELECT coalesce(r.doc_id, s.doc_id) AS doc_id, coalesce(r.page, s.page) AS page, r.doc_id IS NOT NULL AS has_first,
    coalesce(r.text, '') AS first_text, coalesce(s.other, '') AS other, avg_confidence, min_confidence,
    coalesce(line_count, 0) AS line_count, coalesce(low_confidence, TRUE) AS low_confidence,
    coalesce(complex_layout, FALSE) AS complex_layout,
    CASE WHEN r.text IS NULL OR r.text = '' THEN 'no_ocr_text' WHEN low_confidence THEN 'low_confidence'
         WHEN complex_layout THEN 'complex_layout' ELSE '' END AS reason
  FROM readings r FULL OUTER JOIN second s ON r.doc_id = s.doc_id AND r.page = s.page),
combined AS (
  SELECT *, reason <> '' AND other <> '' AS used,
    CASE WHEN has_first THEN first_text ELSE other END AS raw_text,
    CASE WHEN NOT (reason <> '' AND other <> '') THEN first_text
         WHEN has_first AND reason = 'complex_layout' THEN
           CASE WHEN lower(regexp_replace(first_text, '\\s+', '', 'g')) = lower(regexp_replace(other, '\\s+', '', 'g'))
                THEN first_text ELSE first_text || chr(10) || chr(10) || other END
         ELSE other END AS clean_text,
    CASE WHEN NOT (reason <> '' AND other <> '') THEN 'ocr' WHEN NOT has_first THEN 'vision'
         WHEN reason = 'complex_layout' THEN 'hybrid' ELSE 'vision_fallback' END AS mode
  FROM both_pages)"""


@query(
    "combine_page_readings",
    "OCR2",
    f"""WITH {_RECOGNISED}, {_READINGS}, {_SECOND}
    SELECT doc_id, page, mode, reason, used AS second_used, clean_text FROM combined
    WHERE clean_text <> '' OR raw_text <> ''""",
)
def combine_page_readings(spark, sf_dir):
    first = P.page_readings(_recognised(spark, sf_dir))
    return P.combine_readings(first, _second(spark, sf_dir)).select(
        "doc_id", "page", "mode", "reason", "second_used", "clean_text"
    )


@query(
    "page_reading_metadata",
    "OCR3",
    f"""WITH {_RECOGNISED}, {_READINGS}, {_SECOND}
    SELECT doc_id, page, CASE WHEN raw_text = '' THEN '' ELSE sha256(raw_text) END AS raw_hash,
      length(raw_text) AS raw_chars, length(clean_text) AS clean_chars, left(raw_text, 12000) AS raw_text,
      length(raw_text) > 12000 AS raw_truncated, CASE WHEN first_text <> '' THEN sha256(first_text) END AS first_hash,
      CASE WHEN used THEN sha256(other) END AS other_hash, mode, used AS second_used, line_count, low_confidence,
      complex_layout, CAST(round(CAST(avg_confidence AS DECIMAL(18, 9)), 4) AS DOUBLE) AS avg_confidence, CAST(round(CAST(min_confidence AS DECIMAL(18, 9)), 4) AS DOUBLE) AS min_confidence
    FROM combined WHERE clean_text <> '' OR raw_text <> ''""",
)
def page_reading_metadata(spark, sf_dir):
    first = P.page_readings(_recognised(spark, sf_dir))
    return P.reading_metadata(P.combine_readings(first, _second(spark, sf_dir)))


@query(
    "sparse_pages",
    "OCR4",
    f"""WITH {_RECOGNISED}
    SELECT doc_id, page, CAST(sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS BIGINT) AS chars FROM once
    GROUP BY doc_id, page HAVING page <= 80 AND sum(length(regexp_replace(text, '\\s+', '', 'g'))) < 30""",
)
def sparse_pages(spark, sf_dir):
    lines = _recognised(spark, sf_dir).filter(F.col("line_no") % 2 == 0)
    return P.sparse_pages(lines)
