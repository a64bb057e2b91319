"""Host folders and JSON lines as tables."""

import json
import os

from pyspark.sql import functions as F

from arbor.operators import scan, trace
from arbor.sources import host
from arbor.streaming import events


def test_import_keeps_links_and_hidden_files(spark, tmp_path):
    (tmp_path / "dir/sub").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "dir/.hidden").write_bytes(b"\x00\x9f")
    (tmp_path / "dir/_skip").write_text("one\ntwo\n")
    os.link(tmp_path / "a.txt", tmp_path / "dir/sub/again.txt")
    os.symlink("../a.txt", tmp_path / "dir/link")
    tree, content = host.import_tree(spark, str(tmp_path))
    rows = {r["path"]: r for r in tree.collect()}
    assert set(rows) == {"/", "/a.txt", "/dir", "/dir/.hidden", "/dir/_skip", "/dir/link", "/dir/sub", "/dir/sub/again.txt"}
    assert rows["/a.txt"]["serial"] == rows["/dir/sub/again.txt"]["serial"] != rows["/dir/_skip"]["serial"]
    assert rows["/a.txt"]["content_id"] == rows["/dir/_skip"]["content_id"] and content.count() == 2
    assert (rows["/dir/link"]["target"], rows["/dir/link"]["kind"], rows["/dir/link"]["mode"], rows["/dir/link"]["size"]) == ("../a.txt", 3, 0o777, 8)
    told = host.readable(content)
    assert {r["is_text"] for r in told.collect()} == {True, False}
    shown = told.withColumn("text", F.coalesce("text", F.lit("\0")))
    assert sorted((r["path"], r["n"], r["line"]) for r in scan.grep(tree, shown, "tw").collect()) == [(p, 2, "two") for p in ("/a.txt", "/dir/_skip", "/dir/sub/again.txt")]
    assert scan.grep_skipped(tree, shown).first().asDict() == {"searched": 3, "skipped": 1}
    assert scan.grep(tree, shown, "one\n").count() == 3 and scan.grep(tree, shown, "o\nt").count() == 0


def test_trace_lines(spark, tmp_path):
    lines = [{"trace": 1, "id": str(i), "method": "m", "project": "p" if i % 2 else "q", "start": f"2026-01-0{i + 1}T00:00:00Z", "phase": "end"} for i in range(4)]
    (tmp_path / "agent.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"trace": 2, "id": "x"}\nnot json\n')
    calls = trace.read_lines(spark, str(tmp_path))
    assert sorted(r["id"] for r in calls.collect()) == ["0", "1", "2", "3"] and {r["actor"] for r in calls.collect()} == {"agent"}
    assert [r["id"] for r in trace.read_lines(spark, str(tmp_path), "p", "2026-01-03T00:00:00Z").collect()] == ["3"]
    out = str(tmp_path / "out")
    events.drained(events.tail(spark, str(tmp_path / "*.jsonl"), "q"), out, out + "-checkpoint")
    (tmp_path / "more.jsonl").write_text(json.dumps(lines[0] | {"id": "9"}))
    events.drained(events.tail(spark, str(tmp_path / "*.jsonl"), "q"), out, out + "-checkpoint")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["0", "2", "9"]


def test_polls_tell_what_changed(spark):
    model = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    first, version = events.changed(None, model)
    assert first and events.changed(version, model) == (False, version)
    assert events.changed(version, model.unionAll(model))[0]
