"""Logs through files: a followed directory after restarts, an interval log with its line numbers, exports."""

import json

from pyspark.sql import functions as F

from trafficlens.operators import interval_log as L
from trafficlens.sources import access_log as A

LINE = '10.1.2.3 - - [05/Mar/2024:10:{:02d}:12 +0100] "GET /{} HTTP/1.1" 200 512 "-" "Foo"'


def test_a_followed_directory_numbers_lines_like_the_whole_log(spark, tmp_path):
    logs, folder = tmp_path / "logs", f"file://{tmp_path}/followed"
    logs.mkdir()
    n = 0
    for day, chunks in enumerate(((3, 1), (2,), (), (4, 4, 1))):  # four calls, the third finds nothing new
        for k, size in enumerate(chunks):
            (logs / f"access-{day}-{k}.log").write_text("".join(LINE.format(n + i, n + i) + "\n" for i in range(size)))
            n += size
        got = sorted((r.line_id, r.line, str(r.ts)) for r in A.follow_access_log(spark, f"file://{logs}", folder).collect())
        want = sorted((r.line_id, r.line) for r in A.read_access_log(spark, f"file://{logs}").collect())
        assert [g[:2] for g in got] == want and [g[0] for g in got] == list(range(n))
        assert got[0][2] == "2024-03-05 10:00:12"


def log_file(folder, rows):
    folder.mkdir()
    (folder / "part-0.txt").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows[:4]) + "\n")
    (folder / "part-1.txt").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows[4:]) + "\n")


def record(kind, session="s", **more):
    return {"schema_version": 4, "event_type": kind, "session_id": session, **more}


def test_lines_of_files_keep_their_numbers(spark, tmp_path):
    rows = [record("session_start"), "", record("interval", interval=0, log_time="t0", source_lines=["x"]), "{broken", record("command", command_name="purge", status="applied", result={"kept": "3"}), record("interval", interval=1, timestamp="t1"), record("alert", interval=1), "[1]"]
    log_file(tmp_path / "log", rows)
    good, bad = L.read_interval_log(spark, f"file://{tmp_path}/log")
    assert sorted((r.line_no, r.event_type) for r in good.collect()) == [(1, "session_start"), (3, "interval"), (5, "command"), (6, "interval"), (7, "alert")]
    assert sorted((r.line_no, r.text) for r in bad.collect()) == [(4, "{broken"), (8, "[1]")]
    note = L.flatten_notes(good).first()
    assert (note.interval, note.command_name, note.field, note.value) == (1, "purge", "kept", "3")
    m = L.range_manifest(L.select_range(good, "s", 0, 1)).first()
    assert (m.records, m.n_intervals, m.retained_source_intervals, m.first_time, m.last_time, m.versions) == (5, 2, 1, "t0", "t1", "4")

    lines = A.read_access_log(spark, f"file://{tmp_path}/log").select((F.col("line_id") + 1).alias("line_no"), F.col("line").alias("value"))
    L.export_range(lines, L.select_range(good, "s", 1, 1), f"file://{tmp_path}/out")
    kept = [r.line for r in A.read_access_log(spark, f"file://{tmp_path}/out/records").orderBy("line_id").collect()]
    assert [json.loads(x)["event_type"] for x in kept] == ["session_start", "command", "interval", "alert"]
    assert spark.read.json(f"file://{tmp_path}/out/manifest").first().records == 4

    L.write_event_log(good.where("event_type in ('alert', 'command')").select("event_type", "session_id", "interval", "command_name"), f"file://{tmp_path}/events")
    assert sorted((r.event_type, r.session_id) for r in spark.read.json(f"file://{tmp_path}/events").collect()) == [("alert", "s"), ("command", "s")]


def test_each_fault_of_a_range_is_found(spark, tmp_path):
    rows = [record("session_start"), record("interval", interval=0), record("interval", interval=1), record("session_start", "other"), record("interval", "other", interval=7), record("session_start"), record("interval", interval=2), record("interval", interval=2), record("interval", interval=4), record("interval", interval=3)]
    log_file(tmp_path / "log", rows)
    log, _ = L.read_interval_log(spark, f"file://{tmp_path}/log")
    codes = lambda *r: {x.code for x in L.range_errors(log, *r).collect()}
    always = {"duplicate_session_start", "duplicate_interval"}
    assert codes("s", 0, 1) == always
    assert codes("s", 1, 3) == always | {"session_boundary"}
    assert codes("s", 2, 9) == always | {"ambiguous_start", "missing_end"}
    assert codes("s", 9, 2) == always | {"missing_start", "ambiguous_end", "reversed"}
    assert codes("s", 3, 4) == always | {"reversed"}  # by place in the log
    assert codes("other", 7, 7) == set()
    assert codes("none", 0, 0) == {"missing_session_start", "missing_start", "missing_end"}
