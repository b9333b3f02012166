"""Fused and merged hits against their SQL where the lists hold more than one window."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from sextant.catalog.hits import KEEP  # noqa: E402
from sextant.operators import fusion as M  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A document of more lines than a list holds: short ones with a word of seven letters, long ones with one of nine."""
    folder = str(tmp_path_factory.mktemp("sf"))
    lines = [f"sevenxx a{i}" for i in range(KEEP + 5)] + [f"ninexxxxx {'b ' * (i % 3)}c d e f{i}" for i in range(KEEP + 5)]
    docs = spark.createDataFrame([(1, "\n".join(lines), "en", "src1")], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    asked = spark.createDataFrame([(1, "sevenxx and ninexxxxx")], "item_id long, text string")
    asked.coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", ["fuse_query_variants", "merge_search_channels", "single_channel_modes", "best_children"])
def test_hits_past_one_window_are_kept(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet/*.parquet')")
    result = check.compare(spark, con, sf_dir, name, queries(), oracle_sql())
    assert result.startswith("ok"), result


def test_a_single_channel_keeps_the_normal_score(spark):
    # rounded to nine places first, the middle score is shown as 0.113561
    middle = 0.1135604999996
    hits = spark.createDataFrame(
        [("q", "t", "k", c, s, 1) for c, s in (("a", 0.0), ("b", middle), ("c", 1.0))],
        "query_id string, tenant_id string, kb_id string, chunk_id string, score double, variant_count long",
    )
    asked = spark.createDataFrame([("q", "t", "k", "pumps", "keyword", 5)], "query_id string, tenant_id string, kb_id string, query string, mode string, top_k long")
    chunks = hits.select("tenant_id", "kb_id", "chunk_id", F.lit("d").alias("doc_id"), F.lit("p").alias("parent_id")).select(
        "*", F.lit("f").alias("file_name"), F.lit(1).alias("page"), F.create_map(F.lit("x"), F.lit("y")).alias("metadata"), F.lit("z").alias("text")
    )
    got = M.merge_channels(hits.limit(0), hits, asked, chunks).filter("chunk_id = 'b'").select(F.round("score", 6)).first()
    assert got[0] == 0.11356
