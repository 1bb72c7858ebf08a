import json

from sievecast import sources, streaming


def test_session_reports(spark, tmp_path):
    events = [
        ("s", 1, "session_start", None, []),
        ("s", 2, "tool_execution_end", "a.ts", ["x", "y"]),
        ("s", 3, "turn_end", None, []),
        ("s", 4, "context", None, []),
        ("s", 5, "context", None, []),
        ("s", 6, "tool_execution_end", "a.ts", ["y"]),
        ("s", 7, "context", None, []),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "seq", "kind", "file_path", "ids"), e, strict=True))) for e in events))
    stream = spark.readStream.schema("session_id string, seq long, kind string, file_path string, ids array<string>").json(str(folder))
    q = streaming.session_reports(stream).writeStream.format("memory").queryName("reports").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("reports").orderBy("seq").collect()
    assert [(r.seq, r.active, r.resolved, r.report.startswith(streaming.PREAMBLE)) for r in rows] == [(4, 2, 0, True), (7, 1, 1, False)]


def test_read_directory(spark, tmp_path):
    for name, content in (("a.ts", "x"), ("b.bin", "y"), ("node_modules/c.ts", "z"), ("d/e.py", "w")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(content)
    found = sources.read_directory(spark, str(tmp_path)).collect()
    assert sorted(r.content for r in found) == ["w", "x"]
