"""Tokens, phrases, search terms and question rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog.base import CJK_SQL, DOCS, LINE_CHUNKS, QUESTIONS, child_chunks, cjk, questions, table, with_ctes
from sextant.catalog.registry import query
from sextant.catalog.texts import _trim, collapse_sql
from sextant.functions import lexical as L
from sextant.functions import questions as Q
from sextant.operators.keyword import scored_pairs

TOKEN_RE = r"[a-zA-Z0-9][a-zA-Z0-9_+#./-]*|[\x{4e00}-\x{9fff}]+"


def raw_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN_RE}', 0)"


def ngrams_sql(run: str) -> str:
    return (
        f"list_slice(list_concat(list_transform(range(1, greatest(length({run}), 1)), lambda g: substring({run}, g, 2)), "
        f"list_transform(range(1, greatest(length({run}) - 1, 1)), lambda g: substring({run}, g, 3))), 1, 24)"
    )


def index_sql(x: str) -> str:
    """Raw tokens, then the n-grams of CJK runs of two or more."""
    return (
        f"list_concat({raw_sql(x)}, flatten(list_transform(list_filter({raw_sql(x)}, "
        f"lambda r: regexp_full_match(r, '[\\x{{4e00}}-\\x{{9fff}}]{{{{2,}}}}')), lambda r: {ngrams_sql('r')})))"
    ).replace("{{", "{").replace("}}", "}")


def ordered_distinct(x: str) -> str:
    """Distinct values of a list in order of first appearance."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def tokens_sql(x: str) -> str:
    return ordered_distinct(index_sql(x))


def _exploded(source: str, key: str, expr: str, name: str) -> str:
    """Ordered distinct values of a list expression, one row each."""
    return f"""listed AS (SELECT {key}, {expr} AS vs FROM {source}),
    flat AS (SELECT {key}, unnest(vs) AS {name}, generate_subscripts(vs, 1) AS i FROM listed),
    firsts AS (SELECT {key}, {name}, min(i) AS i FROM flat GROUP BY {key}, {name})
    SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) AS BIGINT) AS n, {name} FROM firsts"""


@query("tokenize_documents", "LEX1", "WITH " + _exploded("documents", "doc_id", index_sql("text"), "token"))
def tokenize_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(L.tokenize("text")).alias("pos", "token")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("n"), "token"
    )


@query(
    "tokenize_cjk_texts",
    "LEX1 LEX2",
    f"WITH src AS (SELECT item_id, {CJK_SQL} AS text FROM benchmark), "
    + _exploded("src", "item_id", index_sql("text"), "token"),
)
def tokenize_cjk_texts(spark, sf_dir):
    texts = table(spark, sf_dir, "benchmark").select("item_id", cjk(F.col("text")).alias("text"))
    return texts.select("item_id", F.posexplode(L.tokenize("text")).alias("pos", "token")).select(
        "item_id", (F.col("pos") + 1).cast("long").alias("n"), "token"
    )


# questions in CJK with openings and closings, one per message
_ASK = (
    "CASE turn % 4 WHEN 0 THEN '请帮我查一下 ' WHEN 1 THEN '请问，第三章' WHEN 2 THEN '关于' ELSE '' END || "
    f"{CJK_SQL} || CASE turn % 3 WHEN 0 THEN '主要包括哪些内容呢？' WHEN 1 THEN '是什么' ELSE ' ?' END"
)


def _asked(spark, sf_dir):
    turn = F.col("turn")
    opening = (
        F.when(turn % 4 == 0, F.lit("请帮我查一下 "))
        .when(turn % 4 == 1, F.lit("请问，第三章"))
        .when(turn % 4 == 2, F.lit("关于"))
        .otherwise(F.lit(""))
    )
    closing = (
        F.when(turn % 3 == 0, F.lit("主要包括哪些内容呢？")).when(turn % 3 == 1, F.lit("是什么")).otherwise(F.lit(" ?"))
    )
    text = F.concat(opening, cjk(F.col("text")), closing)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("query"))


_BREAK = r"[\r\n\t,;:!?，。！？；：、（）()\[\]{}<>《》“”‘’\"'']+"
_SEGMENTS = f"""asked AS (SELECT conv_id, turn, lower({_ASK}) AS q FROM conversations),
sources AS (
  SELECT conv_id, turn, 0 AS src, {collapse_sql('q')} AS s FROM asked
  UNION ALL SELECT conv_id, turn, 1, regexp_replace(q, '\\s+', '', 'g') FROM asked),
pieces AS (
  SELECT conv_id, turn, src, unnest(regexp_split_to_array(s, '{_BREAK}')) AS piece,
         generate_subscripts(regexp_split_to_array(s, '{_BREAK}'), 1) AS i FROM sources),
segments AS (
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY src, i) AS BIGINT) AS n,
         {_trim('piece')} AS segment FROM pieces WHERE {_trim('piece')} <> '')"""


@query("phrase_segments", "LEX3", f"WITH {_SEGMENTS} SELECT * FROM segments")
def phrase_segments(spark, sf_dir):
    rows = _asked(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(L.phrase_segments("query")).alias("pos", "segment")
    )
    return rows.select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("n"), "segment")


_OPEN = "^(" + "|".join(L.QUESTION_PREFIXES) + ")"
_CLOSE = "(" + "|".join(L.QUESTION_SUFFIXES) + ")$"
_ROUND = _trim(f"regexp_replace({_trim(f"regexp_replace(phrase, '{_OPEN}', '')")}, '{_CLOSE}', '')")
_STRIPPED = f"""stripping(conv_id, turn, n, phrase, again) AS (
  SELECT conv_id, turn, n, {collapse_sql('segment')}, TRUE FROM segments
  UNION ALL
  SELECT conv_id, turn, n, {_ROUND}, {_ROUND} <> phrase FROM stripping WHERE again),
stripped AS (SELECT conv_id, turn, n, phrase FROM stripping WHERE NOT again)"""


@query(
    "strip_question_words",
    "LEX4",
    f"WITH RECURSIVE {_SEGMENTS}, {_STRIPPED} SELECT conv_id, turn, n, phrase FROM stripped",
)
def strip_question_words(spark, sf_dir):
    rows = _asked(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(L.phrase_segments("query")).alias("pos", "segment")
    )
    return rows.select(
        "conv_id", "turn", (F.col("pos") + 1).cast("long").alias("n"),
        L.strip_question_words(F.col("segment")).alias("phrase"),
    )


_CANDIDATES = r"""edged AS (
  SELECT conv_id, turn, n, regexp_replace(phrase, '^[ \-_/\\]+|[ \-_/\\]+$', '', 'g') AS p FROM stripped),
dense AS (SELECT *, regexp_replace(p, '\s+', '', 'g') AS d FROM edged),
listed AS (
  SELECT conv_id, turn, n, list_concat(list_concat([p], list_filter(regexp_split_to_array(p, '\s+'), lambda x: length(x) >= 4)),
    list_concat(CASE WHEN d <> p THEN [d] ELSE [] END,
      CASE WHEN regexp_matches(d, '^第[一二三四五六七八九十百千万0-9]+[章节篇部分条款](.{4,})$')
           THEN [regexp_extract(d, '^第[一二三四五六七八九十百千万0-9]+[章节篇部分条款](.{4,})$', 1)] ELSE [] END)) AS cs
  FROM dense WHERE length(d) >= 4),
flat AS (SELECT conv_id, turn, n, unnest(cs) AS phrase, generate_subscripts(cs, 1) AS i FROM listed),
firsts AS (SELECT conv_id, turn, phrase, min(n * 1000000 + i) AS spot FROM flat GROUP BY ALL)"""


@query(
    "phrase_terms",
    "LEX5",
    f"WITH RECURSIVE {_SEGMENTS}, {_STRIPPED}, {_CANDIDATES} SELECT conv_id, turn, "
    "CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY spot) AS BIGINT) AS n, phrase FROM firsts",
)
def phrase_terms(spark, sf_dir):
    rows = _asked(spark, sf_dir).select(
        "conv_id", "turn", F.posexplode(L.phrase_terms("query")).alias("pos", "phrase")
    )
    return rows.select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("n"), "phrase")


# --- questions of the benchmark: their search terms, in SQL ---

BENCH_TERMS = rf"""q_sources AS (
  SELECT item_id, 0 AS src, {collapse_sql('lower(text)')} AS s FROM benchmark
  UNION ALL SELECT item_id, 1, lower(regexp_replace(text, '\s+', '', 'g')) FROM benchmark),
q_pieces AS (
  SELECT item_id, src, unnest(regexp_split_to_array(s, '{_BREAK}')) AS piece,
         generate_subscripts(regexp_split_to_array(s, '{_BREAK}'), 1) AS i FROM q_sources),
q_phrases AS (
  SELECT item_id, src, i, regexp_replace({_trim('piece')}, '^[ \-_/\\]+|[ \-_/\\]+$', '', 'g') AS p FROM q_pieces),
q_dense AS (SELECT *, regexp_replace(p, '\s+', '', 'g') AS d FROM q_phrases),
q_listed AS (
  SELECT item_id, src, i, list_concat(list_concat([p], list_filter(regexp_split_to_array(p, '\s+'), lambda x: length(x) >= 4)),
    CASE WHEN d <> p THEN [d] ELSE [] END) AS cs FROM q_dense WHERE length(d) >= 4),
q_flat AS (
  SELECT item_id, unnest(cs) AS term, src * 1000000 + i * 1000 + generate_subscripts(cs, 1) AS spot FROM q_listed),
phrase_list AS (SELECT item_id, term, min(spot) AS spot FROM q_flat GROUP BY item_id, term),
token_flat AS (
  SELECT item_id, unnest({raw_sql('text')}) AS term, 10000000 + generate_subscripts({raw_sql('text')}, 1) AS spot FROM benchmark),
token_list AS (SELECT item_id, term, min(spot) AS spot FROM token_flat GROUP BY item_id, term),
all_terms AS (
  SELECT item_id, term, min(spot) AS spot FROM (SELECT * FROM phrase_list UNION ALL SELECT * FROM token_list) GROUP BY item_id, term)"""


@query(
    "search_terms",
    "LEX5 LEX9 LEX10",
    f"""WITH {BENCH_TERMS}
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY spot) AS BIGINT) AS n, term FROM all_terms""",
)
def search_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(L.search_terms("text")).alias("pos", "term")
    )
    return rows.select("item_id", (F.col("pos") + 1).cast("long").alias("n"), "term")


LIKE_TERMS = BENCH_TERMS + r""",
like_pool AS (
  SELECT item_id, term, min(spot) AS spot FROM all_terms
  WHERE length(regexp_replace(term, '\s+', '', 'g')) >= 2 GROUP BY item_id, term),
like_weighted AS (
  SELECT *, length(regexp_replace(term, '\s+', '', 'g')) AS len,
    CASE WHEN length(regexp_replace(term, '\s+', '', 'g')) >= 8 THEN 6
         WHEN length(regexp_replace(term, '\s+', '', 'g')) >= 4 THEN 3 ELSE 1 END AS weight FROM like_pool),
like_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, len DESC, spot) AS rn FROM like_weighted),
like_list AS (SELECT item_id, term, weight, CASE WHEN rn <= 8 THEN weight + 2 END AS meta_weight, rn FROM like_ranked WHERE rn <= 16)"""


@query(
    "like_terms",
    "LEX7 LEX8",
    f"""WITH {LIKE_TERMS}
    SELECT item_id, CAST(rn AS BIGINT) AS n, term, CAST(weight AS BIGINT) AS weight, CAST(weight + 2 AS BIGINT) AS meta_weight
    FROM like_list""",
)
def like_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(L.like_terms(L.search_terms("text"))).alias("pos", "term")
    )
    return rows.select(
        "item_id",
        (F.col("pos") + 1).cast("long").alias("n"),
        "term",
        L.term_weight(F.col("term")).cast("long").alias("weight"),
        L.metadata_term_weight(F.col("term")).cast("long").alias("meta_weight"),
    )


@query(
    "required_prefixes",
    "LEX10",
    f"""WITH listed AS (SELECT item_id, unnest({raw_sql('text')}) AS prefix, generate_subscripts({raw_sql('text')}, 1) AS i FROM benchmark),
    firsts AS (SELECT item_id, prefix, min(i) AS i FROM listed GROUP BY item_id, prefix)
    SELECT item_id, n, prefix FROM (
      SELECT item_id, prefix, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) AS BIGINT) AS n FROM firsts) WHERE n <= 16""",
)
def required_prefixes(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(L.required_prefixes("text")).alias("pos", "prefix")
    )
    return rows.select("item_id", (F.col("pos") + 1).cast("long").alias("n"), "prefix")


@query(
    "query_keywords",
    "LEX12",
    f"""WITH src AS (SELECT conv_id, turn, {index_sql(_ASK)} AS ts FROM conversations),
    flat AS (SELECT conv_id, turn, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM src),
    firsts AS (SELECT conv_id, turn, t, min(i) AS i FROM flat WHERE length(t) >= 4 OR
      regexp_full_match(t, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM firsts),
    listed AS (SELECT conv_id, turn, string_agg(t, '|' ORDER BY i) AS k FROM best WHERE n <= 4 GROUP BY ALL)
    SELECT conv_id, turn, coalesce(k, '') AS keywords FROM conversations LEFT JOIN listed USING (conv_id, turn)""",
)
def query_keywords(spark, sf_dir):
    return _asked(spark, sf_dir).select(
        "conv_id", "turn", F.array_join(L.query_keywords("query"), "|").alias("keywords")
    )


@query(
    "rerank_terms",
    "LEX13",
    rf"""WITH {BENCH_TERMS},
    spread AS (SELECT item_id, regexp_replace(text, '[/\\|,;:，；、()\[\]{{}}<>]', ' ', 'g') AS s FROM benchmark),
    spread_flat AS (SELECT item_id, unnest({raw_sql('s')}) AS term, 20000000 + generate_subscripts({raw_sql('s')}, 1) AS spot FROM spread),
    merged AS (SELECT item_id, term, min(spot) AS spot FROM (SELECT * FROM all_terms UNION ALL SELECT * FROM spread_flat) GROUP BY item_id, term)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY spot) AS BIGINT) AS n, term FROM merged""",
)
def rerank_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(L.rerank_terms("text")).alias("pos", "term")
    )
    return rows.select("item_id", (F.col("pos") + 1).cast("long").alias("n"), "term")


@query(
    "lexical_scores",
    "LEX6",
    with_ctes(
        DOCS,
        BENCH_TERMS,
        f"""toks AS (SELECT kb_id, doc_id, list_distinct({raw_sql('text')}) AS ts, lower(text) AS low FROM docs),
    termlists AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list(term) AS terms FROM all_terms GROUP BY item_id),
    scored AS (
      SELECT item_id || '@' || kb_id AS query_id, doc_id,
        (len(list_intersect(terms, ts)) + 0.5 * len(list_filter(terms, lambda t: contains(low, t)))) / greatest(sqrt(len(ts)), 1) AS score
      FROM toks, termlists WHERE len(ts) > 0)""",
        select="SELECT query_id, doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM scored WHERE score > 0",
    ),
)
def lexical_scores(spark, sf_dir):
    from sextant.catalog.base import documents

    docs = documents(spark, sf_dir).withColumn("chunk_id", F.col("doc_id"))
    return scored_pairs(questions(spark, sf_dir), docs).select(
        "query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score")
    )


# --- question rules ---

_FOLLOW = (
    "CASE turn % 6 WHEN 0 THEN 'Hello' WHEN 1 THEN '这个' || text WHEN 2 THEN role || ' asks this?' "
    "WHEN 3 THEN text || '吗' WHEN 4 THEN '它？' ELSE text END"
)


def _follow_ups(spark, sf_dir):
    turn = F.col("turn")
    text = (
        F.when(turn % 6 == 0, F.lit("Hello"))
        .when(turn % 6 == 1, F.concat(F.lit("这个"), F.col("text")))
        .when(turn % 6 == 2, F.concat("role", F.lit(" asks this?")))
        .when(turn % 6 == 3, F.concat("text", F.lit("吗")))
        .when(turn % 6 == 4, F.lit("它？"))
        .otherwise(F.col("text"))
    )
    reply = F.when(turn % 2 == 0, F.concat(F.lit(' "'), F.col("text"), F.lit('" '))).otherwise(F.lit("no"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.alias("query"), (turn > 0).alias("has_history"), Q.clean_rewrite(reply).alias("rewritten")
    )


_REPLY = (
    f"left({collapse_sql(_trim("trim(trim(" + _trim("CASE WHEN turn % 2 = 0 THEN ' \"' || text || '\" ' ELSE 'no' END") + ", '\"'), '''')"))}, 500)"
)
_GREET = "('hi','hello','hey','你好','您好','在吗','谢谢','感谢','ok','好的','嗯')"
_GATE = f"""asked AS (
  SELECT conv_id, turn, {_FOLLOW} AS query, turn > 0 AS has_history, {_REPLY} AS rewritten FROM conversations),
dense AS (SELECT *, lower(regexp_replace(query, '\\s+', '', 'g')) AS d FROM asked),
gated AS (
  SELECT *, CASE WHEN d = '' OR d IN {_GREET} THEN FALSE WHEN NOT has_history THEN FALSE
    WHEN regexp_matches(query, '{Q.PRONOUNS}') THEN length(d) >= 4 WHEN length(d) < 8 THEN FALSE
    ELSE length(d) <= 24 AND regexp_matches(query, '[?？吗呢]') END AS needed,
    length(rewritten) BETWEEN 4 AND 500 AND lower(rewritten) NOT IN {_GREET} AND rewritten <> query AS accepted
  FROM dense)"""


@query(
    "rewrite_gate",
    "QRY2 QRY3",
    f"""WITH {_GATE} SELECT conv_id, turn, needed, accepted,
      CASE WHEN needed AND accepted THEN rewritten ELSE query END AS retrieval_query FROM gated""",
)
def rewrite_gate(spark, sf_dir):
    rows = _follow_ups(spark, sf_dir)
    return rows.select(
        "conv_id",
        "turn",
        Q.needs_rewrite("query", "has_history").alias("needed"),
        Q.accepts_rewrite("query", "rewritten").alias("accepted"),
        Q.retrieval_query("query", "rewritten", "has_history").alias("retrieval_query"),
    )


@query(
    "expand_queries",
    "QRY1",
    f"""WITH {BENCH_TERMS},
    pool AS (
      SELECT item_id, text || ' more' AS v, -2 AS spot FROM benchmark UNION ALL SELECT item_id, text, -1 FROM benchmark
      UNION ALL SELECT item_id, term, spot FROM phrase_list),
    firsts AS (SELECT item_id, v, min(spot) AS spot FROM pool GROUP BY item_id, v)
    SELECT item_id, n, v AS variant FROM (
      SELECT item_id, v, CAST(row_number() OVER (PARTITION BY item_id ORDER BY spot) AS BIGINT) AS n FROM firsts) WHERE n <= 3""",
)
def expand_queries(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", "text", F.concat("text", F.lit(" more")).alias("rewritten")
    )
    return rows.select(
        "item_id", F.posexplode(L.expanded_queries("text", "rewritten", 3)).alias("pos", "variant")
    ).select("item_id", (F.col("pos") + 1).cast("long").alias("n"), "variant")


@query(
    "candidate_windows",
    "QRY4",
    """WITH ks AS (SELECT DISTINCT o_orderkey AS query_id, 1 + o_orderkey % 50 AS k FROM orders)
    SELECT query_id, k AS top_k, greatest(k * 24, 40) AS candidates, greatest(k * 3, 40) AS cross_kb,
      greatest(k, 14, least(40, k * 4)) AS parents, k * 3 AS hits FROM ks""",
)
def candidate_windows(spark, sf_dir):
    ks = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 50 + 1).alias("top_k")
    )
    return ks.select(
        "query_id",
        "top_k",
        Q.candidate_window("top_k").alias("candidates"),
        Q.cross_kb_window("top_k").alias("cross_kb"),
        Q.parent_window("top_k").alias("parents"),
        Q.hit_window("top_k").alias("hits"),
    )


_DRAFT = (
    "CASE turn % 6 WHEN 0 THEN 'Find the contract: ' WHEN 1 THEN '起草 一份 合 同' WHEN 2 THEN 'A tem plate of ' "
    "WHEN 3 THEN 'tender ' WHEN 4 THEN '给我一份章程' ELSE '' END || text"
)


@query(
    "full_document_trigger",
    "QRY5",
    f"""WITH q AS (SELECT conv_id, turn, lower(regexp_replace({_DRAFT}, '\\s+', '', 'g')) AS d FROM conversations)
    SELECT conv_id, turn, regexp_matches(d, '{Q.TEMPLATE_WORDS}') OR (regexp_matches(d, '{Q.DOCUMENT_WORDS}')
      AND (regexp_matches(d, '{Q.DRAFT_WORDS}') OR regexp_matches(d, '{Q.WHOLE_WORDS}'))) AS whole FROM q""",
)
def full_document_trigger(spark, sf_dir):
    turn = F.col("turn")
    opening = (
        F.when(turn % 6 == 0, F.lit("Find the contract: "))
        .when(turn % 6 == 1, F.lit("起草 一份 合 同"))
        .when(turn % 6 == 2, F.lit("A tem plate of "))
        .when(turn % 6 == 3, F.lit("tender "))
        .when(turn % 6 == 4, F.lit("给我一份章程"))
        .otherwise(F.lit(""))
    )
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(opening, F.col("text")).alias("query")
    )
    return rows.select("conv_id", "turn", Q.wants_full_document("query").alias("whole"))
