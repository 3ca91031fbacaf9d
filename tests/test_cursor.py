"""The stream source with a cursor: limits, ranges, ties, restarts."""

import csv
import shutil
import sqlite3

import pytest

from watchwell.sources.cursor import CursorSource, _File, _Table

COLUMNS = "id,event_time,who"


def database(path, rows):
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE IF NOT EXISTS events (id INTEGER, event_time TEXT, who TEXT)")
        con.executemany("INSERT INTO events VALUES (?, ?, ?)", rows)
    con.close()


def stream(spark, **options):
    spark.dataSource.register(CursorSource)
    return spark.readStream.format("cursor").options(columns=COLUMNS, ts="event_time", id="id", **options).load()


def run(frame, folder, log):
    """All that is there now, batch by batch; log gets the ids of each."""
    query = frame.writeStream.foreachBatch(lambda b, n: log.append([int(r.id) for r in b.collect()])).option("checkpointLocation", folder).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        query.awaitTermination()


def rows_of(n, first=0):
    return [(first + i, f"2026-03-16 10:{i // 60 % 60:02}:{i % 60:02}", f"u{i % 3}") for i in range(n)]


def test_table_is_read_in_limits_and_restarts_lose_and_repeat_nothing(spark, tmp_path):
    path, folder, log = str(tmp_path / "db"), str(tmp_path / "c"), []
    same_time = [(i, "2026-03-16 09:00:00", "u") for i in (11, 10, 9)]
    database(path, rows_of(20, 100) + same_time)
    options = {"module": "sqlite3", "target": path, "table": "events", "limit": 8, "partitions": 3}
    run(stream(spark, **options), folder, log)
    read = [i for b in log for i in b]
    assert sorted(read) == sorted([*range(100, 120), 9, 10, 11]) and len(log) >= 2
    assert sorted(log[0])[:3] == [9, 10, 11]
    database(path, [(500, "2026-03-16 11:00:00", "u"), (501, "2026-03-16 11:00:00", "u")])
    run(stream(spark, **options), folder, log)
    database(path, [(502, "2026-03-16 11:00:00", "u"), (1, "2026-03-16 08:00:00", "late")])
    run(stream(spark, **options), folder, log)
    assert [i for b in log for i in b][23:] == [500, 501, 502]  # what lies behind the cursor is not read
    shutil.rmtree(f"{folder}/commits")  # the last batch was planned, not done: it comes again
    again = []
    run(stream(spark, **options), folder, again)
    assert [i for b in again for i in b][-1] == 502


def test_csv_ids_by_value_then_text(spark, tmp_path):
    path, folder, log = str(tmp_path / "in.csv"), str(tmp_path / "c"), []
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows([["12", "2026-03-16T10:00:01", "a"], ["11", "2026-03-16T10:00:00Z", "line\nend"], [], ["x"], ["10", "2026-03-16T05:00:00-05:00", "b"], ["9", "never", "c"], ["", "2026-03-16T10:00:00", "d"]])
    options = {"path": path, "limit": 2}
    run(stream(spark, **options), folder, log)
    assert [i for b in log for i in b] == [10, 11, 12]
    with open(path, "a", newline="") as f:
        csv.writer(f).writerow(["13", "2026-03-16T10:00:01", "e"])
    run(stream(spark, **options), folder, log)
    assert log[-1] == [13]
    source = _File(path, tuple(COLUMNS.split(",")), "event_time", "id")
    first = source.cursors(None, None, 2, 2)
    assert [c[1] for c in first] == ["11"] and [r[0] for r in source.rows(None, first[-1])] == ["10", "11"]
    assert [r[0] for r in source.rows(first[-1], source.cursors(first[-1], None, 2, 2)[-1])] == ["12", "13"]


def test_ranges_cover_a_batch_once(tmp_path):
    path = str(tmp_path / "db")
    database(path, [*rows_of(50), (None, "2026-03-16 10:00:00", "x"), (99, None, "x")])
    source = _Table("sqlite3", path, "events", ("id", "who"), "event_time", "id")
    end = source.cursors(None, None, 37, 37)[-1]
    cuts = source.cursors(None, end, None, 10)
    got = [r for after, to in zip([None, *cuts], cuts) for r in source.rows(after, to)]
    assert [int(i) for i, _ in got] == list(range(37)) and len(cuts) == 4
    assert source.cursors(source.cursors(None, None, None, 1000)[-1], None, 10, 10) == []
    with pytest.raises(ValueError, match="not a name"):
        _Table("sqlite3", path, "events; DROP TABLE events", ("id",), "event_time", "id")


def test_start_cursor(spark, tmp_path):
    path, log = str(tmp_path / "db"), []
    database(path, rows_of(6))
    run(stream(spark, module="sqlite3", target=path, table="events", start_ts="2026-03-16 10:00:02", start_id="2"), str(tmp_path / "c"), log)
    assert [i for b in log for i in b] == [3, 4, 5]
