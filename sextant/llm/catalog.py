"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sextant.catalog.base import table
from sextant.llm import bpe, embedding_blocks, fill_middle, html_tree, licenses, line_runs, packing, quality_rules, secrets, simhash, spelling, suffix_buckets, token_files

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def oracle(sql: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLES[fn.__name__] = sql
        return fn

    return add


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


@query
def op5_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are written as flat token files first, which are then scanned."""
    path = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return token_files.scan(spark, path)


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


@query
def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_buckets.digest(table(spark, sf_dir, "documents"))


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
@oracle(
    """WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND array_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
)
def op10_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_blocks.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
@oracle(
    r"""WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (
  SELECT *, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS units,
    list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(digest, 1 + 8 * k, 8) AS BIGINT)) AS h FROM t),
cuts AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
    greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b FROM h),
parts AS (
  SELECT doc_id, text, n, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
    array_to_string(units[b + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
      WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts"""
)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


@query
@oracle(
    r"""WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM lowered),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b),
    lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)]))) AS h FROM bytes, tab),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT x.word, y.word AS near, y.n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.a || h.b
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.a || h.b),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS root FROM judged UNION ALL
  SELECT k.word, j.form FROM walk k JOIN judged j ON j.word = k.root AND j.form IS NOT NULL),
ends AS (SELECT k.word, k.root FROM walk k JOIN judged j ON j.word = k.root AND j.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)"""
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
@oracle(
    r"""WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c ON c.key = k.key GROUP BY doc_id"""
)
def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(table(spark, sf_dir, "documents"))
