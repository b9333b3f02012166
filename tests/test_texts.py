import hashlib
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from sextant.operators import pages as P  # noqa: E402
from sextant.operators import vector_search as N  # noqa: E402


def test_a_text_without_lines_has_no_title(spark, tmp_path):
    # the title was empty, which the SQL has as null
    texts = ["", " \n \t", None, "\n First \nSecond", "x" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = sorted(con.execute(oracle_sql()["first_lines"]).fetchall())
    assert [t for _, t in wanted] == [None, None, None, "First", "x" * 160]
    assert sorted(tuple(r) for r in queries()["first_lines"](spark, str(tmp_path)).collect()) == wanted


def test_scores_of_a_page_are_added_in_the_order_of_its_lines(spark):
    # the last digit of a mean, and with it low_confidence at the limit, hung on the order in which rows came
    rows, means = [], {}
    for page in range(200):
        scores = [((page * 37 + i * i * 61) % 60 + 38) / 100 for i in range(40)]
        means[page] = _plain_sum(scores) / 40
        rows += [("d", page, i, f"{page} line {i}", s) for i, s in enumerate(scores)]
    lines = spark.createDataFrame(rows, "doc_id string, page int, line_no long, text string, score double")
    got = P.page_readings(lines.repartition(7, F.col("line_no"))).select("page", "avg_confidence", "low_confidence").collect()
    assert {r["page"]: r["avg_confidence"] for r in got} == means
    assert all(r["low_confidence"] == (means[r["page"]] < 0.55) for r in got)


def _plain_sum(values):
    """Left to right; Python's own sum of floats is compensated since 3.12."""
    total = 0.0
    for x in values:
        total += x
    return total


def test_texts_are_embedded_by_distinct_tokens_of_each(monkeypatch):
    # a few texts at a time, and none at all; a token counts once in a text, and one without tokens has no vector
    monkeypatch.setattr(N, "EMBEDDED", 2)
    tokens = [["oil", "pump", "a-b"], [], ["oil"], ["条款条", "条款", "款条", "条款条", "x1"], ["pump", "oil"]]
    texts = ["oil pump a-b oil", " !", "oil", "条款条x1", "pump\n,oil"]
    run = N._hashed_texts(64)
    got = run(pa.array(texts)).to_pylist()
    for words, vector in zip(tokens, got):
        total = np.zeros(64)
        for word in set(words):
            digest = hashlib.sha1(word.encode()).digest()
            total[int.from_bytes(digest[:4], "big") % 64] += 1 if digest[4] < 128 else -1
        size = np.sqrt((total * total).sum())
        assert vector == ((total / size).astype(np.float32).tolist() if size else None)
    assert len(run(pa.array([], pa.string()))) == 0
