"""Fill-in-middle against a plain version and an exact round trip."""

import hashlib
import re

import pyarrow as pa
import pytest

from sextant.llm import fill_middle

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, rate=100):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na", "é\nĀ😀\n<p>\r\nx", "one <S> mark", "<M>", "<<P\n>\n<", "<\nS>\n<P",
    "x\n" * 5000, "no line end " * 50_000, " \t\n\x00\n",
]


def rows():
    return [(i, t, "x", "y") for i, t in enumerate(TEXTS * 3)] + [(None, "n\nu\nl\nl\n", "x", "y"), (5, "a\n", "x", "y"), (5, "a\n", "x", "y")]


def frame(spark, found):
    # extra columns with the names that the operator makes
    return spark.createDataFrame(found, "doc_id long, text string, output string, form string")


@pytest.mark.parametrize("rate", [100, 40, 0])
def test_forms_and_round_trip(spark, rate):
    got = fill_middle.rearrange(frame(spark, rows()), rate=rate)
    want = [plain(i, t, rate) for i, t, *_ in rows()]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    back = fill_middle.restore(got).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t, *_ in rows()), key=repr)


def test_empty_table(spark):
    assert fill_middle.digest(frame(spark, rows()).limit(0)).collect() == []


def test_bounded_runs():
    batch = pa.RecordBatch.from_pydict({"text": ["aaaa", None, "b" * 30, "", "cc", "dddddddd"]})
    parts = list(fill_middle.runs(batch, "text", most=8))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 8 for p in parts)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in fill_middle.digest(docs).collect()}
    forms = set()
    for d in docs.collect():
        r, (_, n, form, a, b, output) = got[d["doc_id"]], plain(d["doc_id"], d["text"])
        forms.add(form)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, a, b)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert {"psm", "spm"} <= forms
