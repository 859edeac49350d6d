import hashlib
from collections import defaultdict

from peakloom.llm import common, line_dedup
from tests.llm.data import frame, odd_documents, simple

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\r\x0b\f").translate(UPPER)
    low = lambda i: -(2**63) if i is None else i
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(low(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != low(i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_documents(spark):
    got = sorted(map(tuple, line_dedup.dedup_lines(frame(spark)).collect()), key=str)
    assert got == brute(odd_documents())


def test_many_batches(spark):
    rows = [(k, f"this line is in every third document {k % 3}\nand this one only in document number {k}") for k in range(40)]
    got = sorted(map(tuple, line_dedup.dedup_lines(simple(spark, rows), batches=7, fanout=3).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_columns_pass_through(spark):
    out = line_dedup.drop_lines(frame(spark))
    assert out.columns[: len(frame(spark).columns)] == frame(spark).columns
    assert out.count() == len(odd_documents())


def many(n=40):
    return [(k, f"this line is in every third document {k % 3}\nthis line is in every document there is\nand this one only in document number {k}\n" + "a line often in one document\n" * (k % 7)) for k in range(n)]


def test_hot_and_other_lines(spark, monkeypatch):
    for hot in (1, 4, 10_000):
        monkeypatch.setattr(common, "HOT", hot)
        got = sorted(map(tuple, line_dedup.dedup_lines(simple(spark, many())).collect()), key=str)
        assert got == brute(many())


def test_the_merge_against_the_runs_decides(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.LineRuns, "marked", lambda self, batch: batch.withColumnRenamed("top", "keeper"))
    got = sorted(map(tuple, line_dedup.dedup_lines(simple(spark, many())).collect()), key=str)
    assert got != brute(many())


def run_of(spark, runs, rows):
    return runs._write(spark.createDataFrame(rows, "h1 long, h2 long, keeper long, n_docs long, n_rows long").repartition(runs.buckets, "h1", "h2"))


def test_runs_merge_without_an_exchange(spark):
    runs = line_dedup.LineRuns(spark)
    older, newer = run_of(spark, runs, [(k, k, k, 1, 2) for k in range(100)]), run_of(spark, runs, [(k, k, None if k < 100 else k, 1, 1) for k in range(50, 150)])
    with runs._sorted_scans():
        merged = runs.merged(older, newer)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, merged.collect())) == [(k, k, k, 2 if 50 <= k < 100 else 1, 3 if 50 <= k < 100 else 2 if k < 50 else 1) for k in range(150)]
        runs.levels = [[newer], [older]]
        batch = spark.createDataFrame([(k, k, 7, 1, 1) for k in range(145, 155)], "h1 long, h2 long, top long, n_docs long, n_rows long")
        assert sorted((r.h1, r.keeper) for r in runs.marked(batch).collect()) == [(k, None if k < 150 else 7) for k in range(145, 155)]
    runs._forget(older, newer)


def test_nothing_stays_in_the_catalog(spark):
    line_dedup.dedup_lines(simple(spark, many())).collect()
    left = [t.tableName for t in spark.sql("SHOW TABLES").collect() if t.tableName.startswith("peakloom_run")]
    assert left == []
