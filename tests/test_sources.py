import pytest

from peakloom.sources import dictionary, peaks, results, usage
from peakloom.streaming import usage as streams


def rows(df):
    return [tuple(r) for r in df.orderBy("sample_id", "peak_id").collect()]


def test_text_peaks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n100.5\n\n  7 \r\n1e2\n")
    assert rows(peaks.text_peaks(spark, str(tmp_path / "a.txt"))) == [("a.txt", 1, 100.5), ("a.txt", 2, 7.0), ("a.txt", 3, 100.0)]
    (tmp_path / "b.txt").write_text("1\nx2\n")
    with pytest.raises(Exception, match="not a peak"):
        peaks.text_peaks(spark, str(tmp_path / "b.txt")).collect()


def test_msd_peaks(spark, tmp_path):
    text = '<x><peak mz="1"/><peaklist n="2"></peaklist>'
    (tmp_path / "LN_1_2AA.msd").write_text('<a><peak mz="9"/><peaklist>\n<peak intensity="3" mz="100.25">\n<peak mz="7"></peaklist><peak mz="8">')
    got = peaks.msd_peaks(spark, str(tmp_path / "LN_1_2AA.msd"))
    assert rows(got) == [("LN_1_2AA.msd", 1, 100.25), ("LN_1_2AA.msd", 2, 7.0)]
    assert peaks.with_sniffed_mode(got).select("mode", "matrix").first()[:] == ("neg_h", "2aa_nr")
    (tmp_path / "n.msd").write_text("<peak mz='1'>")
    with pytest.raises(Exception, match="no peaklist"):
        peaks.msd_peaks(spark, str(tmp_path / "n.msd")).collect()
    lenient = spark.createDataFrame([("s", '<PEAKLIST><peak mz="1.5"><peak mz="bad"><peak mz="2"></PeakList>'), ("t", text)], "sample_id string, content string")
    assert rows(peaks.lenient_msd_peaks(lenient)) == [("s", 1, 1.5), ("s", 2, 2.0)]


def test_lenient_text(spark):
    content = "# c\n12.5\nname\t7.25\t3\na 1; b\nmz=44.1x\nnothing\n\n"
    got = peaks.lenient_text_peaks(spark.createDataFrame([("s", content), ("e", ""), ("n", None)], "sample_id string, content string"))
    assert rows(got) == [("s", 1, 12.5), ("s", 2, 7.25), ("s", 3, 1.0), ("s", 4, 44.1)]


def test_uploads(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("5 \xb5g\n6".encode("latin-1"))
    (tmp_path / "v.msd").write_text('<peaklist><peak mz="3"></peaklist>')
    assert rows(peaks.uploaded_peaks(spark, str(tmp_path))) == [("u.txt", 1, 5.0), ("u.txt", 2, 6.0), ("v.msd", 1, 3.0)]
    assert peaks.pasted_lines(" 1 \n#x\n\n2", "9") == "1\n2\n"
    assert peaks.pasted_lines(" \n#", "9\n") == "9\n" and peaks.pasted_lines(None) is None


def test_dictionary(spark, tmp_path):
    book = dictionary.blocks(spark).orderBy("ord").collect()
    assert len(book) == 16 and book[0]["name"] == "Hex" and book[0].max_limit == 10
    assert [dictionary.blocks(spark, None, t).count() for t in ("permethylated", "peracetylated", None)] == [12, 9, 37]
    path = tmp_path / "blocks.txt"
    path.write_text("# x\nA\t10\ncommon\tbad\nB\t20\trare\nC\t10\tMOD\t3\tnative\tA full name\n_free_red_end\t1.5\tmeta\t0\tnative\n")
    got = {r["name"]: r for r in dictionary.blocks(spark, str(path), sep="\t").collect()}
    assert set(got) == {"A", "B", "C"} and got["A"].max_limit == 10 and got["B"].max_limit == 4 and got["C"].category == "mod" and got["C"].full_name == "A full name"
    assert [(r["name"], r.mass) for r in dictionary.one_per_mass(dictionary.blocks(spark, str(path), sep="\t")).orderBy("ord").collect()] == [("C", 10.0), ("B", 20.0)]
    assert [tuple(r) for r in dictionary.free_reducing_ends(spark, str(path)).collect()] == [("native", 1.5)]
    assert {r.glycan_type: r.mass for r in dictionary.free_reducing_ends(spark).collect()}["peracetylated"] == 102.0317
    assert [r["name"] for r in dictionary.labels(spark).orderBy("ord").collect()] == ["2-AA", "2-AB", "3-AQ"]


def test_result_files(spark, tmp_path):
    path = tmp_path / "results.tsv"
    path.write_text("Peak_ID\tObserved\tModel\tModel_BIC\tReconstructed\tError\tStatus\tFormula\tHex\tdHex\n1\t10.5\tHex\t-3.25\t10.4\t0.1\tGOOD\tx\t2\t\n2\t11\tConsensus\t\t9\t2\tBAD\tx\t1.0\tz\n")
    facts, names = results.results(spark, str(path))
    assert names == ["Hex", "dHex"]
    assert [tuple(r) for r in facts.orderBy("peak_id").collect()] == [("Hex", 1, 10.5, 10.4, 0.1, "GOOD", -3.25, [2, 0]), ("Consensus", 2, 11.0, 9.0, 2.0, "BAD", None, [1, 0])]
    (tmp_path / "blocks.tsv").write_text("Block\tValue\tTheoretical\tType\nCommon\t5\t5\tfixed\nHex\t162.1\t162\tknown\n")
    assert [tuple(r) for r in results.fitted_blocks(spark, str(tmp_path / "blocks.tsv")).collect()] == [("Hex", 162.1, "known")]
    (tmp_path / "dep.tsv").write_text("Block\tDirect_Dependencies\tBiosynthetic_Order\nA\t(root)\t0\nC\tA+B\t2\n")
    assert sorted(tuple(r) for r in results.dependency_edges(spark, str(tmp_path / "dep.tsv")).collect()) == [("A", "C", 2), ("B", "C", 2)]
    (tmp_path / "cand.tsv").write_text("Median\tScore\tSize\tStatus\n162.4\t5\t3\tACTIVE\n1\t0\t1\tFILTERED\n500\t1\t1\tACTIVE\n")
    got = results.active_candidates(spark, str(tmp_path / "cand.tsv"), dictionary.blocks(spark)).orderBy("mass").collect()
    assert [(r.mass, r["name"], r.category) for r in got] == [(162.4, "Hex", "common"), (500.0, None, "unknown")]


def test_usage_log_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    assert usage.events(spark, path).count() == 0
    for kind in ("solve", "visit", "solve"):
        usage.record(spark, path, kind)
    assert sorted((r.id, r.kind) for r in usage.events(spark, path).collect()) == [(1, "solve"), (2, "visit"), (3, "solve")]
    q = streams.running_totals(streams.event_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName("usage_totals_test").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.kind: r.n for r in spark.table("usage_totals_test").collect()} == {"solve": 2, "visit": 1}
    w = streams.windowed_counts(streams.event_stream(spark, path)).writeStream.outputMode("update").format("memory").queryName("usage_windows_test").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert sum(r.n for r in spark.table("usage_windows_test").collect()) == 3
