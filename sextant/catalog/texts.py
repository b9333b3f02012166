"""Text cleaning, tables-to-documents and recognised pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog.base import UNTIDY, table, untidy, cjk, CJK_SQL
from sextant.catalog.registry import query
from sextant.functions import strings as S

_TRIM = r"regexp_replace({0}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


def _trim(x: str) -> str:
    return _TRIM.format(x)


_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace({0}, '\\x00', ' ', 'g'), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), "
    "'\\n{{3,}}', chr(10) || chr(10), 'g')"
)


def clean_sql(x: str) -> str:
    return _trim(_CLEAN.format(x))


def collapse_sql(x: str) -> str:
    return _trim(f"regexp_replace({x}, '[\\s\\x0b]+', ' ', 'g')")


@query(
    "clean_documents",
    "SRC1 TXT1",
    f"""SELECT doc_id, {clean_sql(UNTIDY)} AS text FROM documents WHERE {clean_sql(UNTIDY)} <> ''""",
)
def clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", untidy(F.col("text")).alias("text"))
    return docs.withColumn("text", S.clean_text("text")).filter("text <> ''")


@query("clean_pages", "TXT1", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.clean_text("html").alias("text"))


def _line_rules(x: str) -> str:
    x = _trim(f"regexp_replace({x}, '[ \\t\\r\\f\\x0b]+', ' ', 'g')")
    x = f"regexp_replace({x}, '[\\s\\x0b]+([,.;:!?、。，；：！？])', '\\1', 'g')"
    x = f"regexp_replace({x}, '([(\\[{{（【《])[\\s\\x0b]+', '\\1', 'g')"
    x = f"regexp_replace({x}, '[\\s\\x0b]+([)\\]}}）】》])', '\\1', 'g')"
    # no look-around here: two passes cover overlapping neighbours
    for _ in range(2):
        x = f"regexp_replace({x}, '([\\x{{4e00}}-\\x{{9fff}}])[\\s\\x0b]+([\\x{{4e00}}-\\x{{9fff}}])', '\\1\\2', 'g')"
    return x


def normalize_sql(source: str, key: str, expr: str) -> str:
    """Per-line rules, then a window over the lines drops consecutive repeats."""
    return f"""
lines AS (
  SELECT {key}, unnest(regexp_split_to_array({expr}, '\\r\\n|[\\n\\r\\x0b\\f]')) AS raw,
         generate_subscripts(regexp_split_to_array({expr}, '\\r\\n|[\\n\\r\\x0b\\f]'), 1) AS i
  FROM {source}),
tidy AS (SELECT {key}, i, {_line_rules('raw')} AS line FROM lines),
kept AS (
  SELECT {key}, i, line, lower(regexp_replace(line, '[\\s\\x0b]+', '', 'g')) AS k FROM tidy WHERE line <> ''),
marked AS (SELECT *, lag(k) OVER (PARTITION BY {key} ORDER BY i) AS before FROM kept)
SELECT {key}, string_agg(line, chr(10) ORDER BY i) AS text
FROM marked WHERE before IS NULL OR before <> k GROUP BY {key}"""


@query(
    "normalize_recognised_lines",
    "TXT2",
    "WITH source AS (SELECT doc_id, text FROM documents), " + normalize_sql("source", "doc_id", UNTIDY).strip(),
)
def normalize_recognised_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(S.has_text("text")).select("doc_id", untidy(F.col("text")).alias("text"))
    return docs.select("doc_id", S.normalize_lines("text").alias("text"))


@query(
    "normalize_cjk_lines",
    "TXT2",
    "WITH source AS (SELECT doc_id, text FROM documents), " + normalize_sql("source", "doc_id", CJK_SQL).strip(),
)
def normalize_cjk_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(S.has_text("text")).select("doc_id", cjk(F.col("text")).alias("text"))
    return docs.select("doc_id", S.normalize_lines("text").alias("text"))


@query(
    "join_unique_texts",
    "TXT3",
    f"""WITH msgs AS (SELECT conv_id, turn, {collapse_sql('text')} AS t FROM conversations),
    twice AS (
      SELECT conv_id, t, turn * 2 AS slot FROM msgs WHERE t <> ''
      UNION ALL SELECT conv_id, translate(t, 'aeio', 'AEIO'), turn * 2 + 1 FROM msgs WHERE t <> ''),
    firsts AS (
      SELECT *, row_number() OVER (
        PARTITION BY conv_id, lower(regexp_replace(t, '\\s+', '', 'g')) ORDER BY slot) AS rn FROM twice),
    tidy AS (SELECT conv_id, slot, {_line_rules('t')} AS t FROM firsts WHERE rn = 1)
    SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY slot) AS text FROM tidy GROUP BY conv_id""",
)
def join_unique(spark, sf_dir):
    # every message is offered twice, the second time with other letter case
    msgs = table(spark, sf_dir, "conversations").select("conv_id", "turn", S.collapse("text").alias("t"))
    pair = F.array("t", F.translate("t", "aeio", "AEIO"))
    per_conv = msgs.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", pair.alias("texts")))).alias("m")
    )
    texts = F.flatten(F.transform("m", lambda x: x["texts"]))
    return per_conv.select("conv_id", S.join_unique_texts(texts).alias("text")).filter("text <> ''")


@query(
    "compact_previews",
    "TXT4",
    f"""WITH t AS (SELECT doc_id, {collapse_sql(UNTIDY)} AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 220 THEN s ELSE {_trim('left(s, 220)')} || '...' END AS preview FROM t""",
)
def compact_previews(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", untidy(F.col("text")).alias("text"))
    return docs.select("doc_id", S.compact_text("text", 220).alias("preview"))


@query(
    "normalize_question_texts",
    "TXT5",
    "SELECT item_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS dense FROM benchmark",
)
def normalize_question_texts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.normalize_query("text").alias("dense"))


@query(
    "first_lines",
    "TXT6",
    f"""SELECT doc_id, left(list_filter(list_transform(regexp_split_to_array({UNTIDY}, '\\r\\n|[\\n\\r\\x0b\\f]'),
    lambda x: {_trim('x')}), lambda x: x <> '')[1], 160) AS title FROM documents""",
)
def first_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", untidy(F.col("text")).alias("text"))
    # a text without a line has no title
    return docs.select("doc_id", F.nullif(S.first_line("text"), F.lit("")).alias("title"))


# completions: the first sentence of a message is put into a reasoning block; the block
# of a message with an even turn is left open
_COMPLETION = (
    "'<THINK>' || regexp_extract(text, '^[^.]*', 0) || CASE WHEN turn % 2 = 1 THEN '</think>' ELSE '' END "
    "|| regexp_replace(text, '^[^.]*', '') || CASE WHEN turn % 2 = 1 THEN ' <think>late' ELSE '' END"
)


@query(
    "split_completions",
    "TXT7 TXT8",
    f"""WITH c AS (SELECT conv_id, turn, {_COMPLETION} AS done FROM conversations)
    SELECT conv_id, turn,
      array_to_string(regexp_extract_all(done, '(?is)<think>(.*?)(?:</think>|$)', 1), '') AS reasoning,
      regexp_replace(done, '(?is)<think>.*?(</think>|$)', '', 'g') AS answer,
      {_trim("regexp_replace(done, '(?is)<think>.*?(</think>|$)', '', 'g')")} AS final_answer FROM c""",
)
def split_completions(spark, sf_dir):
    odd = F.col("turn") % 2 == 1
    done = F.concat(
        F.lit("<THINK>"),
        F.regexp_extract("text", "^[^.]*", 0),
        F.when(odd, F.lit("</think>")).otherwise(F.lit("")),
        F.regexp_replace("text", r"\A[^.]*", ""),
        F.when(odd, F.lit(" <think>late")).otherwise(F.lit("")),
    )
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", done.alias("done"))
    return c.select(
        "conv_id",
        "turn",
        S.reasoning_text("done").alias("reasoning"),
        S.answer_text("done").alias("answer"),
        S.strip_thinking("done").alias("final_answer"),
    )


@query(
    "parse_score_replies",
    "TXT9",
    """SELECT event_id, CASE event_type
         WHEN 'error' THEN NULL WHEN 'signup' THEN NULL
         ELSE ROUND(value / 100 + 0.25, 6) END AS total FROM events""",
)
def parse_score_replies(spark, sf_dir):
    # replies of five shapes: plain, fenced, chatty, an object, no array at all
    value = F.format_string("[%s, 0.25]", (F.col("value") / 100).cast("string"))
    reply = (
        F.when(F.col("event_type") == "view", value)
        .when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), value, F.lit("\n```")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Scores: "), value, F.lit(" as asked.")))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"scores": '), value, F.lit("}")))
        .otherwise(F.lit("I cannot score these."))
    )
    scored = table(spark, sf_dir, "events").select("event_id", S.parse_score_array(reply).alias("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return scored.select("event_id", F.round(total, 6).alias("total"))
