"""Retrieval evaluation over the gold set derived from the passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.catalog.base import with_ctes
from sextant.catalog.hits import _CTES, gold, overlap_hits
from sextant.catalog.registry import query
from sextant.catalog.texts import collapse_sql
from sextant.catalog.base import line_chunks, questions
from sextant.operators import evaluation as E
from sextant.operators.ranking import top_per_group

KS = (1, 3, 5, 10)


def _hits(spark, sf_dir):
    found = top_per_group(
        overlap_hits(spark, sf_dir, 7), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], None, rank="rank"
    )
    details = line_chunks(spark, sf_dir).select("chunk_id", "doc_id", F.col("file_name").alias("title"), "text")
    return found.select("query_id", "rank", "chunk_id", "parent_id", "score").join(details, "chunk_id")


def _errors(spark, sf_dir):
    """Queries of one knowledge base never got a result."""
    return questions(spark, sf_dir).filter("kb_id <> 'fr'").select("query_id", F.lit("").alias("error"))


def _answered(spark, sf_dir):
    return _hits(spark, sf_dir).join(_errors(spark, sf_dir).select("query_id"), "query_id", "left_semi")


def metrics(spark, sf_dir):
    return E.score_items(gold(spark, sf_dir), _answered(spark, sf_dir), KS, _errors(spark, sf_dir))


_METRICS = """targets AS (
  SELECT CAST(item_id AS VARCHAR) || '@' || kb_id AS query_id, list_sort(list(DISTINCT doc_id)) AS doc_ids
  FROM benchmark b JOIN docs d ON contains(d.text, b.text) GROUP BY item_id, kb_id),
gold AS (
  SELECT q.query_id, q.query, q.kb_id, t.doc_ids IS NOT NULL AS answerable, coalesce(t.doc_ids, []) AS doc_ids,
    [q.kb_id, CASE WHEN length(q.query) < 200 THEN 'short' ELSE 'long' END] AS tags,
    CASE WHEN q.kb_id = 'fr' THEN 'missing result' ELSE '' END AS error
  FROM questions q LEFT JOIN targets t ON t.query_id = q.query_id),
results AS (
  SELECT w.query_id, w.chunk_id, k.doc_id, k.parent_id, k.file_name, k.text, w.score,
    row_number() OVER (PARTITION BY w.query_id ORDER BY w.score DESC, w.chunk_id) AS rank
  FROM wide w JOIN kids k ON k.chunk_id = w.chunk_id WHERE w.kb_id <> 'fr'),
judged AS (
  SELECT g.query_id, r.rank, r.doc_id, g.answerable AND list_contains(g.doc_ids, r.doc_id) AS rel
  FROM gold g JOIN results r ON r.query_id = g.query_id),
sums AS (
  SELECT query_id, count(*) AS hit_count, min(CASE WHEN rel THEN rank END) AS matched_rank,
    sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
    """ + ",\n    ".join(
    f"count(CASE WHEN rel AND rank <= {k} THEN 1 END) AS rel_{k}, count(DISTINCT CASE WHEN rel AND rank <= {k} THEN doc_id END) AS ids_{k}"
    for k in KS
) + """ FROM judged GROUP BY query_id),
metrics AS (
  SELECT g.*, CASE WHEN answerable THEN greatest(len(doc_ids), 1) ELSE 0 END AS targets, coalesce(hit_count, 0) AS hit_count, matched_rank,
    CASE WHEN answerable THEN coalesce(1.0 / matched_rank, 0) ELSE 0 END AS rr,
    CASE WHEN answerable THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(greatest(len(doc_ids), 1), 10) AS BIGINT) + 1), lambda r: 1 / log2(r + 1)))
         ELSE CASE WHEN coalesce(hit_count, 0) > 0 THEN 0 ELSE 1 END END AS ndcg,
    """ + ",\n    ".join(
    f"CASE WHEN answerable THEN coalesce(rel_{k}, 0) / {k}.0 ELSE CASE WHEN coalesce(hit_count, 0) > 0 THEN 0 ELSE 1 END END AS p{k}, "
    f"CASE WHEN answerable THEN least(coalesce(ids_{k}, 0) / greatest(len(doc_ids), 1), 1) ELSE CASE WHEN coalesce(hit_count, 0) > 0 THEN 0 ELSE 1 END END AS r{k}, "
    f"NOT answerable AND coalesce(hit_count, 0) > 0 AS f{k}"
    for k in KS
) + """ FROM gold g LEFT JOIN sums s ON s.query_id = g.query_id)"""


def _f(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


@query(
    "evaluate_items",
    "EVL2 EVL3 EVL4 EVL5 EVL6 EVL7 EVL8 EVL13",
    with_ctes(
        *_CTES, _METRICS,
        select="SELECT query_id, answerable, error, CAST(targets AS BIGINT) AS target_count, hit_count, coalesce(matched_rank, 0) AS matched_rank, "
        + f"{_f('rr')} AS reciprocal_rank, {_f('ndcg')} AS ndcg, "
        + ", ".join(f'{_f(f"p{k}")} AS "precision@{k}", {_f(f"r{k}")} AS "recall@{k}", f{k} AS "false_positive@{k}"' for k in KS)
        + " FROM metrics",
    ),
)
def evaluate_items(spark, sf_dir):
    rows = metrics(spark, sf_dir)
    ratios = ["reciprocal_rank", "ndcg", *[f"{m}@{k}" for k in KS for m in ("precision", "recall")]]
    return rows.select(
        "query_id", "answerable", "error",
        F.col("target_count").cast("long").alias("target_count"),
        F.col("hit_count").cast("long").alias("hit_count"),
        F.coalesce("matched_rank", F.lit(0)).cast("long").alias("matched_rank"),
        *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in ratios],
        *[F.col(f"`false_positive@{k}`") for k in KS],
    )


def _summary(precision: bool) -> str:
    out = [
        "count(*) AS total", "count(CASE WHEN answerable THEN 1 END) AS answerable",
        "count(CASE WHEN NOT answerable THEN 1 END) AS unanswerable",
        f"coalesce({_f('avg(CASE WHEN answerable THEN rr END)')}, 0) AS mrr",
        f"coalesce({_f('avg(CASE WHEN answerable THEN ndcg END)')}, 0) AS ndcg",
        "count(CASE WHEN error <> '' THEN 1 END) AS errors",
    ]
    for k in KS:
        if precision:
            out.append(f"coalesce({_f(f'avg(CASE WHEN answerable THEN p{k} END)')}, 0) AS \"precision@{k}\"")
        hit = f"CASE WHEN answerable THEN CASE WHEN matched_rank <= {k} THEN 1.0 ELSE 0.0 END END"
        out += [
            f"coalesce({_f(f'avg(CASE WHEN answerable THEN r{k} END)')}, 0) AS \"recall@{k}\"",
            f"coalesce({_f(f'avg({hit})')}, 0) AS \"hit_rate@{k}\"",
            f"{_f(f'avg(CASE WHEN NOT answerable THEN CASE WHEN f{k} THEN 1.0 ELSE 0.0 END END)')} AS \"false_positive_rate@{k}\"",
        ]
    return ", ".join(out)


@query("evaluation_summary", "EVL9", with_ctes(*_CTES, _METRICS, select=f"SELECT {_summary(True)} FROM metrics"))
def evaluation_summary(spark, sf_dir):
    return E.summarize(metrics(spark, sf_dir), KS)


@query(
    "evaluation_by_tag",
    "EVL10",
    with_ctes(
        *_CTES, _METRICS, "tagged AS (SELECT unnest(tags) AS tag, * FROM metrics)",
        select=f"SELECT tag, {_summary(False)} FROM tagged GROUP BY tag",
    ),
)
def evaluation_by_tag(spark, sf_dir):
    return E.summarize_by_tag(metrics(spark, sf_dir), KS)


_GATES = (("recall@5", 0.85), ("mrr", 0.70), ("hit_rate@1", 0.0), ("map@5", 0.5))


@query(
    "metric_gates",
    "EVL11 EVL14",
    with_ctes(
        *_CTES, _METRICS, f"summary AS (SELECT {_summary(True)} FROM metrics)",
        select="""SELECT 'recall@5' AS metric, CAST(0.85 AS DOUBLE) AS threshold, "recall@5" AS actual, 'below_threshold' AS reason FROM summary WHERE "recall@5" < 0.85
      UNION ALL SELECT 'mrr', 0.7, mrr, 'below_threshold' FROM summary WHERE mrr < 0.7
      UNION ALL SELECT 'hit_rate@1', 0.0, "hit_rate@1", 'below_threshold' FROM summary WHERE "hit_rate@1" < 0
      UNION ALL SELECT 'map@5', 0.5, NULL, 'missing' FROM summary""",
    ),
)
def metric_gates(spark, sf_dir):
    gates = spark.createDataFrame(list(_GATES), "metric string, threshold double")
    return E.gate_failures(E.summarize(metrics(spark, sf_dir), KS), gates)


@query(
    "evaluation_failures",
    "EVL1 EVL12",
    with_ctes(
        *_CTES, _METRICS,
        f"""previews AS (
      SELECT query_id, string_agg(rank || '|' || doc_id || '|' || chunk_id || '|' || parent_id || '|' || file_name || '|' || left({collapse_sql('text')}, 240),
        chr(10) ORDER BY rank) AS shown FROM results WHERE rank <= 10 GROUP BY query_id)""",
        select=f"""SELECT m.query_id, answerable, hit_count, {_f('r10')} AS recall, array_to_string(tags, ',') AS tags, error,
      array_to_string(doc_ids, ',') AS doc_ids, coalesce(shown, '') AS shown
      FROM metrics m LEFT JOIN previews p ON p.query_id = m.query_id
      WHERE (answerable AND r10 < 1) OR (NOT answerable AND f10) OR error <> ''""",
    ),
)
def evaluation_failures(spark, sf_dir):
    hits = _answered(spark, sf_dir)
    rows = E.failure_rows(metrics(spark, sf_dir), hits, KS)
    shown = F.transform(
        "top_hits",
        lambda h: F.concat_ws("|", h["rank"].cast("string"), h["doc_id"], h["chunk_id"], h["parent_id"], h["title"], h["preview"]),
    )
    return rows.select(
        "query_id", "answerable", F.col("hit_count").cast("long").alias("hit_count"),
        F.round(F.col("`recall@10`"), 6).alias("recall"), "tags", "error",
        F.array_join("doc_ids", ",").alias("doc_ids"),
        F.coalesce(F.array_join(shown, "\n"), F.lit("")).alias("shown"),
    )
