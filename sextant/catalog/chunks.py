"""Headings, sections, sentences, chunks and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog.base import HEADED, DOCS, documents, headed, table, with_ctes
from sextant.catalog.registry import query
from sextant.catalog.texts import _trim, clean_sql
from sextant.functions import chunking as C
from sextant.functions import ids
from sextant.operators import chunking as O

_FORMS = (
    r"(?:#{1,6}\s+|第[\x{4e00}-\x{9fff}0-9]+[章节篇部条款]\s*|[一二三四五六七八九十百千万]+[、.．]\s*|"
    r"[0-9]+(?:[.．][0-9]+)*[、.．)）\s]+)"
)
# one line is a heading when a form is followed by 1..160 characters on it
_IS_HEAD = rf"regexp_full_match(line, '\s*{_FORMS}.{{1,160}}')"

_LEVEL = r"""CASE
  WHEN starts_with(ltrim(line), '#') THEN least(length(regexp_extract(ltrim(line), '^#*', 0)), 6)
  WHEN regexp_matches(line, '^\s*第.+[章篇部]') THEN 1
  WHEN regexp_matches(line, '^\s*第.+节') THEN 2
  WHEN regexp_matches(line, '^\s*第.+[条款]') THEN 3
  ELSE greatest(2, least(length(line) - length(translate(line, '.．', '')) + 1, 6)) END"""

_HEAD_LINES = f"""headed AS (SELECT doc_id, {clean_sql(HEADED)} AS text FROM documents WHERE {clean_sql(HEADED)} <> ''),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM headed),
flagged AS (SELECT *, {_IS_HEAD} AS is_head FROM lines)"""

_CLEAN_HEAD = r"left(regexp_replace(regexp_replace(line, '^\s*#{1,6}\s*', ''), '^\s+|\s+$', '', 'g'), 160)"


def _headed_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", headed(F.col("text")).alias("text"))


@query(
    "detect_headings",
    "CHK1 CHK3 CHK4",
    f"""WITH {_HEAD_LINES}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, line AS head,
           CAST({_LEVEL} AS BIGINT) AS level, {_CLEAN_HEAD} AS title
    FROM flagged WHERE is_head""",
)
def detect_headings(spark, sf_dir):
    docs = O.clean_documents(_headed_docs(spark, sf_dir))
    heads = docs.select("doc_id", F.posexplode(C.headings("text")).alias("pos", "head"))
    # a heading match may begin with the newline before it
    bare = F.regexp_replace("head", r"\A\n+", "")
    return heads.select(
        "doc_id",
        (F.col("pos") + 1).cast("long").alias("n"),
        bare.alias("head"),
        C.heading_level("head").cast("long").alias("level"),
        C.clean_heading("head").alias("title"),
    )


@query(
    "table_separators",
    "CHK2",
    r"""WITH src AS (SELECT event_id, CASE event_type WHEN 'view' THEN '|' || repeat('-', CAST(user_id % 5 AS INT) + 1) || '|'
      WHEN 'click' THEN ' :' || repeat('-', CAST(user_id % 4 AS INT)) || ': ' WHEN 'error' THEN '| ' || event_type || ' |'
      WHEN 'signup' THEN '' ELSE props END AS cell FROM events)
    SELECT event_id, regexp_full_match(cell, '\s*\|?[\s:|\-]+\|?\s*') AS is_separator FROM src""",
)
def table_separators(spark, sf_dir):
    kind = F.col("event_type")
    cell = (
        F.when(kind == "view", F.concat(F.lit("|"), F.expr("repeat('-', cast(user_id % 5 as int) + 1)"), F.lit("|")))
        .when(kind == "click", F.concat(F.lit(" :"), F.expr("repeat('-', cast(user_id % 4 as int))"), F.lit(": ")))
        .when(kind == "error", F.concat(F.lit("| "), kind, F.lit(" |")))
        .when(kind == "signup", F.lit(""))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", C.is_table_separator(cell).alias("is_separator"))


# path of a section: the last heading of each smaller level that no heading of its own
# level or above has closed since
_SECTIONS = f"""{_HEAD_LINES},
numbered AS (
  SELECT *, CAST(sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS sec
  FROM flagged),
bodies AS (
  SELECT doc_id, sec, {_trim("string_agg(line, chr(10) ORDER BY i)")} AS text FROM numbered GROUP BY doc_id, sec),
heads AS (SELECT doc_id, sec, {_CLEAN_HEAD} AS title, {_LEVEL} AS level FROM numbered WHERE is_head),
open_heads AS (
  SELECT a.doc_id, a.sec, b.sec AS anc, b.title FROM heads a JOIN heads b ON a.doc_id = b.doc_id AND b.sec < a.sec
  WHERE b.level < a.level AND NOT EXISTS (
    SELECT 1 FROM heads c WHERE c.doc_id = a.doc_id AND c.sec > b.sec AND c.sec <= a.sec AND c.level <= b.level)),
paths AS (
  SELECT h.doc_id, h.sec, coalesce(string_agg(o.title, ' > ' ORDER BY o.anc) || ' > ', '') || h.title AS path
  FROM heads h LEFT JOIN open_heads o ON h.doc_id = o.doc_id AND h.sec = o.sec GROUP BY h.doc_id, h.sec, h.title),
parts AS (
  SELECT b.doc_id, b.sec, b.text,
    coalesce(h.title, left(list_filter(list_transform(string_split(b.text, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')[1], 160)) AS title,
    coalesce(p.path, left(list_filter(list_transform(string_split(b.text, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')[1], 160)) AS path,
    coalesce(h.level, 0) AS level,
    row_number() OVER (PARTITION BY b.doc_id ORDER BY b.sec) - 1 AS idx, count(*) OVER (PARTITION BY b.doc_id) AS n
  FROM bodies b LEFT JOIN heads h ON b.doc_id = h.doc_id AND b.sec = h.sec
  LEFT JOIN paths p ON b.doc_id = p.doc_id AND b.sec = p.sec WHERE b.text <> '')"""


@query(
    "split_sections",
    "CHK5",
    f"""WITH {_SECTIONS}
    SELECT doc_id, CAST(CASE WHEN n > 1 THEN idx ELSE -1 END AS BIGINT) AS section_index, text,
      CASE WHEN n > 1 THEN title END AS section_title, CASE WHEN n > 1 THEN path END AS section_path,
      CAST(CASE WHEN n > 1 THEN level ELSE -1 END AS BIGINT) AS section_level FROM parts""",
)
def split_sections(spark, sf_dir):
    rows = O.section_rows(_headed_docs(spark, sf_dir))
    return rows.withColumn("section_index", F.coalesce("section_index", F.lit(-1)).cast("long")).withColumn(
        "section_level", F.coalesce("section_level", F.lit(-1)).cast("long")
    )


@query(
    "split_sentences",
    "CHK9",
    rf"""WITH s AS (
      SELECT doc_id, list_filter(list_transform(
        regexp_extract_all(text, '[^。！？；;.!?]*[。！？；;.!?]+["'')\]\}}）】》”’]*\s*|[^。！？；;.!?]+$', 0),
        lambda x: {_trim('x')}), lambda x: x <> '') AS parts FROM documents)
    SELECT doc_id, CAST(unnest(generate_series(1, len(parts))) AS BIGINT) AS n, unnest(parts) AS sentence FROM s""",
)
def split_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(C.sentences("text")).alias("pos", "sentence")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("n"), "sentence"
    )


@query(
    "split_paragraphs",
    "CHK7",
    rf"""WITH src AS (SELECT doc_id, {_trim("replace(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), ', ', ',' || chr(13) || chr(10) || '  ')")} AS raw FROM documents),
    norm AS (SELECT doc_id, regexp_replace(raw, '\r\n?', chr(10), 'g') AS body FROM src),
    paras AS (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '\n\s*\n+'), lambda x: {_trim('x')}), lambda x: x <> '') AS ps
      FROM norm)
    SELECT doc_id, CAST(unnest(generate_series(1, len(ps))) AS BIGINT) AS n,
      unnest(list_transform(ps, lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)),
        lambda x: {_trim("regexp_replace(x, '[ ]+', ' ', 'g')")}), lambda x: x <> ''), chr(10)))) AS paragraph FROM paras""",
)
def split_paragraphs(spark, sf_dir):
    loose = F.replace(F.replace("text", F.lit(". "), F.lit(".\n \n")), F.lit(", "), F.lit(",\r\n  "))
    docs = table(spark, sf_dir, "documents").select("doc_id", loose.alias("text"))
    return docs.select("doc_id", F.posexplode(C.paragraphs("text")).alias("pos", "paragraph")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("n"), "paragraph"
    )


@query(
    "heading_aware_lines",
    "CHK8",
    rf"""WITH RECURSIVE cleaned AS (
      SELECT doc_id, {clean_sql(HEADED)} AS body FROM documents),
    src AS (
      SELECT doc_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '') AS ls
      FROM cleaned),
    glue(doc_id, ls, i, n, unit) AS (
      SELECT doc_id, ls, 0, 0, '' FROM src WHERE len(ls) > 0
      UNION ALL
      SELECT doc_id, ls,
        CASE WHEN regexp_full_match(ls[i + 1], '\s*{_FORMS}.{{1,160}}') AND i + 2 <= len(ls)
              AND length(ls[i + 1]) + 1 + length(ls[i + 2]) <= 900 THEN i + 2 ELSE i + 1 END,
        n + 1,
        CASE WHEN regexp_full_match(ls[i + 1], '\s*{_FORMS}.{{1,160}}') AND i + 2 <= len(ls)
              AND length(ls[i + 1]) + 1 + length(ls[i + 2]) <= 900 THEN ls[i + 1] || chr(10) || ls[i + 2] ELSE ls[i + 1] END
      FROM glue WHERE i < len(ls)),
    units AS (SELECT doc_id, n, unit, max(length(unit)) OVER (PARTITION BY doc_id) AS widest FROM glue WHERE n > 0)
    SELECT doc_id, CAST(n AS BIGINT) AS n, unit, widest <= 900 AS accepted FROM units""",
)
def heading_aware_lines(spark, sf_dir):
    docs = O.clean_documents(_headed_docs(spark, sf_dir))
    units = docs.select("doc_id", C.group_heading_lines(C.paragraph_lines(F.col("text")), 900).alias("units"))
    fits = F.forall("units", lambda u: F.length(u) <= 900)
    return units.select("doc_id", fits.alias("accepted"), F.posexplode("units").alias("pos", "unit")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("n"), "unit", "accepted"
    )


@query("parent_chunks", "CHK6")
def parent_chunks(spark, sf_dir):
    return O.parent_rows(documents(spark, sf_dir)).select(
        "tenant_id", "kb_id", "doc_id", "parent_index", "text", "file_name"
    )


@query("child_chunks", "CHK10 CHK11 CHK13")
def child_chunks(spark, sf_dir):
    rows = O.chunk_rows(documents(spark, sf_dir)).filter("chunk_type = 'child'")
    return rows.select(
        "tenant_id", "kb_id", "doc_id", "chunk_id", "parent_id", "parent_index", "child_index", "chunk_index", "text"
    )


@query("headed_chunks", "CHK5 CHK6 CHK10 CHK11 CHK13")
def headed_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", headed(F.col("text")))
    rows = O.chunk_rows(docs)
    return rows.select(
        "chunk_id", "chunk_type", "parent_id", "chunk_index", "text", F.col("metadata")["section_path"].alias("section_path")
    )


@query(
    "hard_split_pieces",
    "CHK11",
    rf"""WITH RECURSIVE src AS (SELECT doc_id, {_trim('text')} AS v FROM documents),
    cuts(doc_id, v, st, en, n) AS (
      SELECT doc_id, v, 0, 0, 0 FROM src WHERE v <> ''
      UNION ALL
      SELECT doc_id, v, nst, CASE WHEN length(v) - nst <= 520 THEN length(v)
           WHEN regexp_matches(substring(v, nst + 261, 260), '[\n 。！？；;,.!?，、]')
           THEN nst + 260 + length(regexp_extract(substring(v, nst + 261, 260), '(?s)^.*[\n 。！？；;,.!?，、]', 0))
           ELSE nst + 520 END, n + 1
      FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(en - 80, st + 1) END AS nst FROM cuts WHERE n = 0 OR en < length(v)))
    SELECT doc_id, CAST(n AS BIGINT) AS n, {_trim('substring(v, st + 1, en - st)')} AS piece FROM cuts WHERE n > 0""",
)
def hard_split_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(C.hard_split(F.col("text"), 520, 80)).alias("pos", "piece")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("n"), "piece"
    )


_UUID5 = (
    "(SELECT substr(h, 1, 12) || '5' || substr(h, 14, 3) || translate(substr(h, 17, 1), '0123456789abcdef', "
    "'89ab89ab89ab89ab') || substr(h, 18, 15) FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0})) AS h))"
)


@query(
    "document_identifiers",
    "CHK12 PRJ6 PRJ7",
    with_ctes(
        DOCS,
        select=f"""SELECT doc_id, {_UUID5.format("'main:' || kb_id || ':None:' || source_uri")} AS fallback_id,
      {_UUID5.format("'main:' || kb_id || ':' || doc_id || ':parent:0:' || left(text, 80)")} AS parent_id,
      {_UUID5.format("'main:' || kb_id || ':' || doc_id || ':child:0:3:' || left(text, 80)")} AS child_id,
      'kb_' || substr(sha1('main:' || kb_id), 1, 24) AS collection,
      CASE WHEN length(text) <= 128 THEN text ELSE sha256(text) END AS fitted FROM docs""",
    ),
)
def document_identifiers(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        ids.document_id("tenant_id", "kb_id", F.lit(None).cast("string"), "source_uri").alias("fallback_id"),
        ids.parent_chunk_id("tenant_id", "kb_id", "doc_id", F.lit(0), "text").alias("parent_id"),
        ids.child_chunk_id("tenant_id", "kb_id", "doc_id", F.lit(0), F.lit(3), "text").alias("child_id"),
        ids.collection_key("tenant_id", "kb_id").alias("collection"),
        ids.fit_identifier(F.col("text")).alias("fitted"),
    )
