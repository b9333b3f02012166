"""Line dedup by sorted runs against a plain version."""

from collections import Counter, defaultdict

import pytest

from sextant.llm import line_runs

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_runs.UPPER, line_runs.LOWER)


def plain(rows, least=10):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[line.strip(BLANKS).translate(LOWER)].add(i)
    common = {k for k, ids in held.items() if k and len(ids) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(BLANKS).translate(LOWER) not in common]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def rows():
    found = [(i, f"Own line {i}\n  SHARED by all\t\nsome {i % 3}\n\n{'hot' if i % 2 else 'Hot '}") for i in range(40)]
    found += [(50 + i, "in nine") for i in range(9)] + [(70 + i, "in ten\r\nİ Kelvin K") for i in range(10)]
    # lines repeated in one document, repeated rows, null ids and texts, line ends only
    found += [(90, "in nine once more\n" * 20), (91, "rep\n" * 12), (50, "in nine"), (70, "in ten\nother"), (None, None), (None, "in nine")]
    found += [(92, None), (93, ""), (94, "\n\n\n"), (95, "hot\n" * 30_000), (96, "\x0bhot\x0c\n hot"), (97, "in nine\n")]
    return found


def frame(spark, found):
    # extra columns with the names that the operator makes
    return spark.createDataFrame([(*r, 1, 2, 3, "c") for r in found], "doc_id long, text string, h1 int, batch int, n_lines int, common string")


@pytest.mark.parametrize("least, batches, fanout", [(10, 8, 4), (10, 5, 2), (3, 1, 4), (1, 3, 2), (1000, 2, 2)])
def test_kept_lines(spark, least, batches, fanout):
    got = line_runs.keep_rare(frame(spark, rows()), least, batches, fanout)
    assert set(got.columns) == {"doc_id", "text", "h1", "batch", "n_lines", "common", "n_dropped"}
    found = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(plain(rows(), least), key=repr)


def test_empty_table(spark):
    assert line_runs.digest(frame(spark, rows()).limit(0)).collect() == []


def test_runs_are_levelled_and_compacted(spark):
    runs = line_runs.LineRuns(spark, least=5, fanout=3)
    assert runs.common().collect() == []
    total = Counter()
    for k in range(11):
        found = [(h, -h) for h in range(20) for _ in range(2 if h == k else 1 if h % 3 == k % 3 else 0)]
        runs.add(spark.createDataFrame(found, "h1 long, h2 long"))
        total.update(h for h, _ in found)
        # as many runs as the digits of the number of batches to the base of the fan-out
        n, digits = k + 1, []
        while n:
            n, d = divmod(n, 3)
            digits.append(d)
        assert [len(level) for level in runs.levels] == digits
    assert {r["h1"] for r in runs.common().collect()} == {h for h, n in total.items() if n >= 5}
    for r in runs.counts().collect():
        assert r["docs"] == total[r["h1"]] if total[r["h1"]] < 5 else r["docs"] >= 5


def test_runs_meet_without_a_shuffle(spark):
    runs = line_runs.LineRuns(spark, fanout=9)
    for k in range(2):
        runs.add(spark.range(100 * k, 100 * k + 300).selectExpr("id AS h1", "-id AS h2"))
    old = [spark.table(n) for n in runs.levels[0]]
    anti = old[0].join(old[1].hint("merge"), line_runs.HASH, "left_anti")
    for rows in (anti, runs.counts()):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {r["h1"]: r["docs"] for r in runs.counts().collect()} == {h: 1 + (100 <= h < 300) for h in range(400)}
