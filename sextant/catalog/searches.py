"""Keyword and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog.base import DOCS, LINE_CHUNKS, QUESTIONS, child_chunks, documents, line_chunks, questions, table, with_ctes
from sextant.catalog.lexicon import BENCH_TERMS, LIKE_TERMS, raw_sql
from sextant.catalog.registry import query
from sextant.functions import vectors as V
from sextant.operators import cell_search as C
from sextant.operators import keyword as K
from sextant.operators import vector_search as N
from sextant.session import store

_CHILDREN = "kids AS (SELECT * FROM chunks WHERE chunk_type = 'child')"

_POSTINGS = f"""tokens AS (SELECT tenant_id, kb_id, chunk_id, unnest({raw_sql('text')}) AS token FROM kids),
postings AS (SELECT tenant_id, kb_id, chunk_id, token, count(*) AS tf FROM tokens GROUP BY ALL)"""


@query(
    "build_postings",
    "KW1",
    with_ctes(DOCS, LINE_CHUNKS, _CHILDREN, _POSTINGS, select="SELECT * FROM postings"),
)
def build_postings(spark, sf_dir):
    return K.build_postings(child_chunks(spark, sf_dir))


# full-text: three words of a passage after the other are asked of whole documents
_ASKS = "asks AS (SELECT item_id, text AS q FROM benchmark)"
_PHRASES = """asks AS (
  SELECT CAST(item_id AS VARCHAR) || '.' || i AS item_id, array_to_string(string_split(text, ' ')[3 * i + 1:3 * i + 3], ' ') AS q
  FROM benchmark, unnest(range((len(string_split(text, ' ')) + 2) // 3)) AS u(i))"""


def phrase_questions(spark, sf_dir):
    words = F.split("query", " ")
    starts = F.sequence(F.lit(0), F.floor((F.size(words) + 2) / 3).cast("int") - 1)
    phrases = F.transform(starts, lambda i: F.array_join(F.slice(words, i * 3 + 1, F.lit(3)), " "))
    rows = questions(spark, sf_dir).select("item_id", "tenant_id", "kb_id", "top_k", F.posexplode(phrases).alias("i", "query"))
    item = F.concat_ws(".", "item_id", F.col("i").cast("string"))
    return rows.select(F.concat_ws("@", item, "kb_id").alias("query_id"), "tenant_id", "kb_id", "query", "top_k")


_WHOLE = "kids AS (SELECT * FROM chunks WHERE chunk_type = 'parent')"


def whole_documents(spark, sf_dir):
    return line_chunks(spark, sf_dir).filter("chunk_type = 'parent'")


_FULLTEXT = f"""pref_flat AS (SELECT item_id, unnest({raw_sql('q')}) AS prefix, generate_subscripts({raw_sql('q')}, 1) AS i FROM asks),
pref AS (
  SELECT item_id, prefix FROM (
    SELECT item_id, prefix, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS n FROM pref_flat GROUP BY item_id, prefix)
  WHERE n <= 16),
freq AS (SELECT token, log10((SELECT count(DISTINCT chunk_id) FROM postings) / count(*)) AS idf FROM postings GROUP BY token),
hits AS (
  SELECT p.prefix, t.kb_id, t.chunk_id, sum(t.tf * f.idf * f.idf) AS points FROM (SELECT DISTINCT prefix FROM pref) p
  JOIN freq f ON starts_with(f.token, p.prefix) JOIN postings t USING (token) GROUP BY ALL),
need AS (SELECT item_id, count(*) AS need FROM pref GROUP BY item_id),
fulltext AS (
  SELECT CAST(p.item_id AS VARCHAR) || '@' || h.kb_id AS query_id, h.kb_id, h.chunk_id, round(sum(h.points), 9) AS score
  FROM pref p JOIN hits h USING (prefix) JOIN need n ON n.item_id = p.item_id
  GROUP BY p.item_id, h.kb_id, h.chunk_id, n.need HAVING count(*) = n.need),
fulltext_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM fulltext) WHERE rn <= 5)"""


@query(
    "fulltext_candidates",
    "KW1",
    with_ctes(
        DOCS, LINE_CHUNKS, _WHOLE, _POSTINGS, _PHRASES, _FULLTEXT,
        select="SELECT query_id, kb_id, chunk_id, round(score, 6) AS score FROM fulltext_top",
    ),
)
def fulltext_candidates(spark, sf_dir):
    index = K.build_keyword_index(store(whole_documents(spark, sf_dir), "chunks"))
    found = K.fulltext_candidates(store(phrase_questions(spark, sf_dir), "questions"), index)
    return found.select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"))


def _like(limit: int) -> str:
    return f"""named AS (SELECT tenant_id, kb_id, chunk_id, lower(text) AS low, lower(file_name) AS name, text FROM kids),
in_text AS (
  SELECT l.item_id, c.kb_id, c.chunk_id, l.weight AS w FROM like_list l JOIN named c ON contains(c.low, l.term)),
in_names AS (
  SELECT l.item_id, c.kb_id, c.chunk_id, l.meta_weight AS w FROM like_list l JOIN named c ON contains(c.name, l.term)
  WHERE l.meta_weight IS NOT NULL),
liked AS (
  SELECT CAST(item_id AS VARCHAR) || '@' || kb_id AS query_id, kb_id, chunk_id, CAST(sum(w) AS DOUBLE) AS score
  FROM (SELECT * FROM in_text UNION ALL SELECT * FROM in_names) GROUP BY item_id, kb_id, chunk_id),
like_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM liked) WHERE rn <= {limit})"""


@query(
    "like_candidates",
    "KW2",
    with_ctes(
        DOCS, LINE_CHUNKS, _CHILDREN, LIKE_TERMS, _like(25),
        select="SELECT query_id, kb_id, chunk_id, score FROM like_top",
    ),
)
def like_candidates(spark, sf_dir):
    index = K.build_keyword_index(store(child_chunks(spark, sf_dir), "chunks"))
    found = K.like_candidates(store(questions(spark, sf_dir), "questions"), index)
    return found.select("query_id", "kb_id", "chunk_id", "score")


_SHORT_TERMS = LIKE_TERMS.replace("FROM benchmark", "FROM asked_items")
_ASKED_PHRASES = "asked_items AS (SELECT item_id FROM asks)"
_ASKED = "asked_items AS (SELECT item_id, text FROM benchmark)"
_SWITCH = """asked AS (SELECT CAST(item_id AS VARCHAR) || '@' || k.kb_id AS query_id, item_id, k.kb_id
  FROM asked_items CROSS JOIN (SELECT DISTINCT kb_id FROM docs) k),
switched AS (
  SELECT a.query_id, a.item_id, a.kb_id, count(f.chunk_id) AS n FROM asked a LEFT JOIN fulltext_top f USING (query_id)
  GROUP BY a.query_id, a.item_id, a.kb_id)"""


@query(
    "like_fallback_switch",
    "KW3",
    with_ctes(
        DOCS, LINE_CHUNKS, _WHOLE, _POSTINGS, _PHRASES, _FULLTEXT, _ASKED_PHRASES, _SWITCH,
        select="SELECT query_id FROM switched WHERE n = 0 OR n < 5",
    ),
)
def like_fallback_switch(spark, sf_dir):
    asked = store(phrase_questions(spark, sf_dir), "questions")
    index = K.build_keyword_index(store(whole_documents(spark, sf_dir), "chunks"))
    return K.needs_like_search(asked, K.fulltext_candidates(asked, index)).select("query_id")


_SEARCH = with_ctes(
    DOCS, LINE_CHUNKS, _CHILDREN, _POSTINGS, _ASKS, _FULLTEXT, _ASKED, _SWITCH, _SHORT_TERMS, _like(25),
    f"""groups AS (
  SELECT query_id, kb_id, chunk_id, score FROM fulltext_top
  UNION ALL SELECT l.query_id, l.kb_id, l.chunk_id, l.score FROM like_top l JOIN switched s USING (query_id) WHERE s.n < 5),
merged AS (SELECT query_id, kb_id, chunk_id, sum(score) AS base FROM groups GROUP BY ALL),
term_lists AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list(term) AS terms FROM all_terms GROUP BY item_id),
rescored AS (
  SELECT m.query_id, m.kb_id, m.chunk_id, round(base + CASE WHEN len(list_distinct({raw_sql('c.text')})) = 0 THEN 0 ELSE
    (len(list_intersect(terms, list_distinct({raw_sql('c.text')}))) + 0.5 * len(list_filter(terms, lambda t: contains(lower(c.text), t))))
    / greatest(sqrt(len(list_distinct({raw_sql('c.text')}))), 1) END, 9) AS score
  FROM merged m JOIN kids c ON c.chunk_id = m.chunk_id JOIN term_lists t ON t.item_id = string_split(m.query_id, '@')[1]),
found AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM rescored WHERE score > 0)
  WHERE rn <= 5)""",
    select="SELECT query_id, kb_id, chunk_id, round(CAST(score AS DOUBLE), 6) AS score FROM found",
)


@query("keyword_search", "KW4 KW5 FLT1", _SEARCH)
def keyword_search(spark, sf_dir):
    asked = store(questions(spark, sf_dir), "questions")
    index = K.build_keyword_index(store(child_chunks(spark, sf_dir), "chunks"))
    fulltext = store(K.fulltext_candidates(asked, index), "fulltext")
    found = K.keyword_search(asked, index, fulltext=fulltext)
    return found.select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"))


# --- vectors: the embeddings table, a scope for all, one question per label ---


def embedding_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.lit("main").alias("tenant_id"),
        F.lit("vectors").alias("kb_id"),
        F.col("label").cast("string").alias("doc_id"),
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("embedding").alias("vector"),
    )


def label_questions(spark, sf_dir, top_k: int = 20):
    """The mean vector of every label, as a unit vector."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector")
    )
    return mean.select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("query_id"),
        F.lit("main").alias("tenant_id"),
        F.lit("vectors").alias("kb_id"),
        F.lit(top_k).cast("long").alias("top_k"),
        F.transform("vector", lambda x: x / F.sqrt(V.squared_norm(F.col("vector")))).alias("vector"),
    )


_LABEL_QUERIES = """cells AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY label, pos),
mean AS (SELECT label, list(m ORDER BY pos) AS v FROM means GROUP BY label),
asked AS (
  SELECT 'label-' || label AS query_id,
         list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS q FROM mean)"""


def _distance_sql(metric: str) -> str:
    e = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
    if metric == "IP":
        return f"list_inner_product(q, {e})"
    if metric == "COSINE":
        return f"list_cosine_similarity(q, {e})"
    return f"list_sum(list_transform(list_zip(q, {e}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _exact_sql(metric: str, limit: int = 20) -> str:
    direction = "ASC" if metric == "L2" else "DESC"
    score = "1 / (1 + greatest(raw, 0))" if metric == "L2" else "(raw + 1) / 2"
    return f"""WITH {_LABEL_QUERIES},
    pairs AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, round({_distance_sql(metric)}, 9) AS raw FROM asked, embeddings),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw {direction}, chunk_id) AS rank FROM pairs)
    SELECT query_id, chunk_id, rank, round(raw, 6) AS raw_score, round(greatest(0, least(1, {score})), 6) AS score
    FROM ranked WHERE rank <= {limit}"""


def _exact(spark, sf_dir, metric):
    found = N.exact_search(label_questions(spark, sf_dir), embedding_rows(spark, sf_dir), metric)
    return found.select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"),
        F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"),
    )


@query("exact_vector_search", "VEC2 VEC3", _exact_sql("L2"))
def exact_vector_search(spark, sf_dir):
    return _exact(spark, sf_dir, "L2")


@query("inner_product_search", "VEC2 VEC3", _exact_sql("IP"))
def inner_product_search(spark, sf_dir):
    return _exact(spark, sf_dir, "IP")


@query("cosine_search", "VEC2 VEC3", _exact_sql("COSINE"))
def cosine_search(spark, sf_dir):
    return _exact(spark, sf_dir, "COSINE")


@query(
    "vector_validation",
    "VEC1",
    """WITH src AS (
      SELECT vec_id, CASE WHEN label = 3 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT))
        WHEN label = 5 THEN list_concat(embedding[1:63], [CAST('nan' AS FLOAT)])
        WHEN label = 7 THEN list_transform(embedding, lambda x: CAST(x * 4 AS FLOAT)) ELSE embedding END AS v FROM embeddings),
    n AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n2 FROM src)
    SELECT vec_id, NOT isnan(n2) AND n2 > 0 AS valid,
      CASE WHEN NOT isnan(n2) AND n2 > 0 THEN round(list_sum(list_transform(v, lambda x, i: CAST(CAST(CAST(x AS DOUBLE) / sqrt(n2) AS FLOAT) AS DOUBLE) * i)), 4) ELSE 0 END AS checksum
    FROM n""",
)
def vector_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("label") == 3, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
        .when(F.col("label") == 5, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .when(F.col("label") == 7, F.transform("embedding", lambda x: (x * 4).cast("float")))
        .otherwise(F.col("embedding"))
        .alias("vector"),
    )
    good, bad = N.validated_vectors(rows)
    weighted = F.transform("vector", lambda x, i: x.cast("double") * (i + 1))
    checksum = F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 4)
    return good.select("vec_id", F.lit(True).alias("valid"), checksum.alias("checksum")).unionByName(
        bad.select("vec_id", F.lit(False).alias("valid"), F.lit(0.0).alias("checksum"))
    )


def vector_questions(spark, sf_dir, top_k: int = 20):
    """Every twentieth vector asks for its neighbours."""
    return embedding_rows(spark, sf_dir).filter(F.col("chunk_id").cast("long") % 20 == 0).select(
        F.col("chunk_id").alias("query_id"), "tenant_id", "kb_id", F.lit(top_k).cast("long").alias("top_k"), "vector"
    )


@query("approximate_vector_search", "VEC4")
def approximate_vector_search(spark, sf_dir):
    cells = C.build_cell_table(store(embedding_rows(spark, sf_dir), "vectors"))
    found = C.search_cells(store(vector_questions(spark, sf_dir), "asked"), cells)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    "vector_recall_report", "VEC4",
    """SELECT 'main' AS tenant_id, 'vectors' AS kb_id, count(*) AS n_queries, TRUE AS recall_is_enough
    FROM embeddings WHERE vec_id % 20 = 0""",
)
def vector_recall_report(spark, sf_dir):
    """Recall against the exact search, and whether it is at least 0.95."""
    vectors, asked = store(embedding_rows(spark, sf_dir), "vectors"), store(vector_questions(spark, sf_dir), "asked")
    near = C.search_cells(asked, C.build_cell_table(vectors))
    report = N.recall_report(N.exact_search(asked, vectors), near)
    return report.select("tenant_id", "kb_id", "n_queries", (F.col("recall") >= 0.95).alias("recall_is_enough"))


_EMBED = f"""feats AS (
  SELECT doc_id, unnest(list_distinct({raw_sql('text')})) AS token FROM documents),
hashed AS (
  SELECT doc_id, CAST(('0x' || substr(sha1(token), 1, 8)) AS BIGINT) % 64 AS dim,
         CASE WHEN substr(sha1(token), 9, 1) < '8' THEN 1.0 ELSE -1.0 END AS sign FROM feats),
dims AS (SELECT doc_id, dim, CAST(sum(sign) AS DOUBLE) AS x FROM hashed GROUP BY doc_id, dim),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM dims GROUP BY doc_id)"""


@query(
    "hashed_embeddings",
    "UDF1",
    f"""WITH {_EMBED} SELECT doc_id, dim, round(CAST(CAST(x / norm AS FLOAT) AS DOUBLE), 5) AS value FROM dims JOIN norms USING (doc_id)
    WHERE x <> 0 AND norm > 0""",
)
def hashed_embeddings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cells = N.embed_rows(docs).select("doc_id", F.posexplode("vector").alias("dim", "value"))
    return cells.filter("value <> 0").select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value")
    )
