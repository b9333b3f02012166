import pytest

from sextant.functions.strings import parse_score_array
from sextant.operators import evaluation as E
from sextant.operators.tables import normalize_columns
from sextant.sources import files


def test_text_files_are_whole_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# one\n\ntwo", encoding="utf-8")
    (tmp_path / "b.txt").write_text("三", encoding="utf-8")
    rows = {r["file_name"]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": "# one\n\ntwo", "b.txt": "三"}


def test_csv_files_of_both_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿名称,值\n甲,007\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("名称,值\n乙,1.50\n".encode("gb18030"))
    rows = files.read_csv(spark, str(tmp_path)).select("名称", "值").collect()
    assert sorted(tuple(r) for r in rows) == [("乙", "1.50"), ("甲", "007")]


GOLD = """# a comment

{"id": "q1", "query": "what", "tenantId": "t", "kbId": "k", "relevant": {"docIds": ["d1"]}, "tags": ["x"]}
{"id": "q2", "query": "none", "tenant_id": "t", "kb_id": "k", "answerable": false}
{"id": "q3", "query": "", "tenant_id": "t", "kb_id": "k"}
not json
"""
RESULTS = """{"queryId": "q1", "hits": []}
{"id": "q1", "hits": [{"chunkId": "c0", "score": 0.9, "citation": {"docId": "d0"}}, {"score": 0.5, "text": " a  b ", "metadata": {"doc_id": "d1", "chunk_id": "c1", "parentId": "p1"}}]}
{"hits": []}
"""


def test_gold_and_results_end_to_end(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text(GOLD, encoding="utf-8")
    (tmp_path / "results.jsonl").write_text(RESULTS, encoding="utf-8")
    gold, bad_gold = files.read_gold(spark, str(tmp_path / "gold.jsonl"))
    results, bad_results = files.read_results(spark, str(tmp_path / "results.jsonl"))
    assert [r["line_no"] for r in bad_gold.orderBy("line_no").collect()] == [5, 6]
    assert bad_results.count() == 1
    hits = E.explode_results(results)
    metrics = E.score_items(gold, hits, (1, 2), results)
    rows = {r["query_id"]: r for r in metrics.collect()}
    assert rows["q1"]["matched_rank"] == 2 and rows["q1"]["reciprocal_rank"] == 0.5
    assert rows["q1"]["recall@1"] == 0.0 and rows["q1"]["recall@2"] == 1.0 and rows["q1"]["precision@2"] == 0.5
    assert rows["q2"]["error"] == "missing result" and rows["q2"]["precision@1"] == 1.0 and rows["q2"]["ndcg"] == 1.0
    summary = E.summarize(metrics, (1, 2)).first()
    assert summary["mrr"] == 0.5 and summary["errors"] == 1 and summary["false_positive_rate@2"] == 0.0
    gates = spark.createDataFrame([("mrr", 0.7), ("recall@2", 0.9), ("map", 0.1)], "metric string, threshold double")
    failed = {r["metric"]: r["reason"] for r in E.gate_failures(E.summarize(metrics, (1, 2)), gates).collect()}
    assert failed == {"mrr": "below_threshold", "map": "missing"}
    out = str(tmp_path / "report")
    E.write_report(metrics, hits, (1, 2), out)
    assert spark.read.json(f"{out}/summary").count() == 1
    assert spark.read.option("header", True).csv(f"{out}/failures_csv").count() == 1  # q2, for its error


def test_k_values_and_gates():
    assert E.parse_k_values("5, 1,5,3") == [1, 3, 5]
    with pytest.raises(ValueError):
        E.parse_k_values("0,1")
    assert E.parse_gates(["recall@5=0.85"]) == [("recall@5", 0.85)]
    with pytest.raises(ValueError):
        E.parse_gates(["recall"])


def test_column_names():
    assert normalize_columns(["a", " ", "a", "Unnamed: 0", "nan", "a"]) == ["a", "column_2", "a_2", "column_4", "column_5", "a_3"]


def test_score_replies(spark):
    texts = ["[0.1, 1]", "```json\n[0.5]\n```", "Scores: [0.2,0.3].", '{"a": [1]}', "no", "[\"x\"]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["s"] for r in df.orderBy("i").select(parse_score_array("t").alias("s")).collect()]
    assert got[:5] == [[0.1, 1.0], [0.5], [0.2, 0.3], None, None]


def test_each_csv_file_keeps_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    rows = files.read_csv(spark, str(tmp_path)).select("x", "y", "z").collect()
    assert sorted(map(tuple, rows), key=str) == [("1", "2", None), (None, "3", "4")]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Many splits of one file, several files, line ends of each kind, a last line without one."""
    texts = {"a.jsonl": "".join(f"line {i} " + "x" * (i % 50) + "\n" for i in range(3000)), "b.jsonl": "one\r\n\r\nthree", "c.jsonl": "\n\n# no\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "7777", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = files.numbered_lines(spark, str(tmp_path))
            assert size == before or rows.rdd.getNumPartitions() > 1
            got = {}
            for r in rows.collect():
                got.setdefault(r["source"].rsplit("/", 1)[-1], []).append((r["line_no"], r["line"]))
            for name, text in texts.items():
                assert sorted(got[name]) == list(enumerate(text.splitlines(), 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_last_line_of_an_id_wins_over_splits(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("".join(f'{{"id": "q{i % 9}", "error": "e{i}"}}\n' for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        last, bad = files.read_results(spark, str(tmp_path / "r.jsonl"))
        assert {r["query_id"]: r["error"] for r in last.collect()} == {f"q{i % 9}": f"e{i}" for i in range(1991, 2000)}
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
