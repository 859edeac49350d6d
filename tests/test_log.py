import threading
from datetime import datetime, timedelta

import pytest

from peakloom.sources import marks, usage
from peakloom.streaming import log

AT = datetime(2024, 1, 1)


def some(spark, kind, n):
    return spark.createDataFrame([(kind, AT + timedelta(minutes=k), 1) for k in range(n)], "kind string, ts timestamp, id int")


def test_two_writers_and_a_replayed_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log.committed(spark, path).count() == 0
    writers = [threading.Thread(target=lambda w=w: [log.write_batch(some(spark, f"w{w}", 20 + b).repartition(3), path, w, b) for b in range(3)]) for w in (0, 1)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    rows = log.committed(spark, path).collect()
    assert len(rows) == 2 * (20 + 21 + 22) == len({r.id for r in rows})
    log.write_batch(some(spark, "w1", 21), path, 1, 1)  # again, as after a failure
    again = log.committed(spark, path).collect()
    assert len(again) == len(rows) == len({r.id for r in again})
    with pytest.raises(ValueError):
        log.write_batch(some(spark, "x", 1), path, 64, 0)


def test_a_batch_without_its_marker_is_not_there(spark, tmp_path):
    path = tmp_path / "log"
    for b in range(2):
        log.write_batch(some(spark, "a", 5), str(path), 0, b)
    (path / "writer=0" / "batch=1" / "_SUCCESS").unlink()
    assert log.committed(spark, str(path)).count() == 5
    log.write_batch(some(spark, "a", 6), str(path), 0, 1)
    assert log.committed(spark, str(path)).count() == 11


def test_a_stream_is_written_once(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))
    some(spark, "a", 7).write.parquet(source)
    for n in (7, 10, 10):
        stream = spark.readStream.schema("kind string, ts timestamp, id int").parquet(source)
        log.append_stream(stream, path, checkpoint).awaitTermination()
        assert log.committed(spark, path).count() == n
        if n == 7:
            some(spark, "b", 3).write.mode("append").parquet(source)


def test_single_events_of_several_writers(spark, tmp_path):
    path = str(tmp_path / "events")
    threads = [threading.Thread(target=usage.record, args=(spark, path, f"k{k}")) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.id for r in usage.events(spark, path).collect()) == [1, 2, 3, 4, 5]


def rows_of(df):
    return [tuple(r) for r in df.orderBy("sample_id", "peak_id").collect()]


def test_msd_file_in_ten_ranges(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        body = "".join(f'<peak intensity="{k % 7}"\n mz="{k / 4}" />junk\n' if k % 5 else '<peak none="1"/>' for k in range(1, 1200))
        (tmp_path / "a.msd").write_text(f'<x><peak mz="9"/><peaklist>{body}</peaklist><peak mz="8"/><peaklist><peak mz="7"/></peaklist>')
        (tmp_path / "b.msd").write_text('<peaklist><peak mz="3"/></peaklist>')
        read = spark.read.option("lineSep", ">").text(str(tmp_path / "a.msd"))
        assert read.rdd.getNumPartitions() >= 10
        want = [("a.msd", p + 1, k / 4) for p, k in enumerate(k for k in range(1, 1200) if k % 5)] + [("b.msd", 1, 3.0)]
        assert rows_of(marks.msd_peaks(spark, str(tmp_path))) == want == rows_of(marks.msd_peaks(spark, str(tmp_path), strict=False))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_strict_and_lenient_msd(spark, tmp_path):
    (tmp_path / "bad.msd").write_text('<PeakList><PEAK MZ="1.5"/><peak mz="x"/><peak mz="2" w="1"/></PEAKLIST>')
    assert rows_of(marks.msd_peaks(spark, str(tmp_path), strict=False)) == [("bad.msd", 1, 1.5), ("bad.msd", 2, 2.0)]
    with pytest.raises(ValueError, match="no peaklist in bad.msd"):
        marks.msd_peaks(spark, str(tmp_path))
    (tmp_path / "bad.msd").write_text('<peaklist><peak mz="x"/></peaklist>')
    with pytest.raises(Exception, match="not a mass: x"):
        marks.msd_peaks(spark, str(tmp_path)).collect()
    (tmp_path / "bad.msd").write_text("")
    assert rows_of(marks.msd_peaks(spark, str(tmp_path), strict=False)) == []
