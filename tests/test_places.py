"""The directory source, spans in ranges, nearest lines, metrics by content, registered patterns in one pass."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sievecast import sources
from sievecast.operators import asof, incremental, rules
from sievecast.operators.registry import Registry
from sievecast.sources import directory

# directory source


@pytest.fixture
def tree(tmp_path):
    for k in range(40):
        p = tmp_path / f"d{k % 4}" / f"f{k:02}.ts"
        p.parent.mkdir(exist_ok=True)
        p.write_text(f"content {k}")
    for name in ("node_modules/x.ts", "d0/yarn.lock", "d0/a.min.js", "d0/b.bin", "d0/node_modules/y.ts"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("no")
    return tmp_path


def test_only_chosen_files_are_read(spark, tree):
    df = sources.read_directory(spark, str(tree), most=7)
    rows = df.collect()
    assert [r.content for r in sorted(rows, key=lambda r: r.file_path)] == [f"content {k}" for k in range(0, 28, 4)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sources.read_directory(spark, str(tree)).count() == 40


def test_listing_stops(tree, monkeypatch):
    listed = []
    real = directory.pa.fs.LocalFileSystem.get_file_info

    class Counting:
        def __init__(self):
            self.fs = directory.pa.fs.LocalFileSystem()

        def get_file_info(self, selector):
            listed.append(selector.base_dir)
            return real(self.fs, selector)

    walked = directory.walk(Counting(), f"{tree}/", frozenset(sources.SKIPPED_FOLDERS))
    assert next(walked)[0].endswith("a.min.js") and len(listed) == 2
    assert len([*walked]) == 42 and len(listed) == 5


def test_opened_files_are_counted(tree, monkeypatch):
    opened = []

    class Fs:
        def open_input_stream(self, path):
            opened.append(path)
            return directory.pa.fs.LocalFileSystem().open_input_stream(path)

        def get_file_info(self, selector):
            return directory.pa.fs.LocalFileSystem().get_file_info(selector)

    monkeypatch.setattr(directory, "open_folder", lambda path: (Fs(), path))
    reader = directory.SourceFilesReader({"path": str(tree), "most": "5", "pattern": r"\.ts$", "filesPerTask": "2", "skippedFolders": "node_modules"})
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 1]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 5 and len(opened) == 5


def test_filters_reach_the_listing(tree):
    class Like:
        attribute = ("file_path",)

    reader = directory.PushingReader({"path": str(tree), "pattern": r"\.ts$", "skippedFolders": "node_modules"})
    left = list(reader.pushFilters([directory.StringStartsWith(("file_path",), f"{tree}/d1/"), directory.In(("file_path",), (f"{tree}/d1/f01.ts", f"{tree}/d2/f02.ts")), Like()]))
    assert len(left) == 1 and [p.paths for p in reader.partitions()] == [[f"{tree}/d1/f01.ts"]]


def test_filters_of_a_query(spark, tree):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = sources.read_directory(spark, str(tree)).filter(F.col("file_path").startswith(f"{tree}/d3/"))
        assert df.count() == 10
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_file_that_goes_is_a_null_row(tree):
    reader = directory.SourceFilesReader({"path": str(tree), "pattern": r"f0[0-3]\.ts$", "skippedFolders": "node_modules"})
    parts = reader.partitions()
    (tree / "d1" / "f01.ts").unlink()
    (tree / "d2" / "f02.ts").write_bytes(b"\xff bytes")
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["content"] for r in sorted(rows, key=lambda r: r["file_path"])] == ["content 0", None, "� bytes", "content 3"]


def test_empty_and_missing_folders(spark, tmp_path):
    assert sources.read_directory(spark, str(tmp_path)).count() == 0
    assert sources.read_directory(spark, str(tmp_path / "none")).count() == 0


# ranges and places


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_in_ranges(spark, block):
    rng = random.Random(block)
    ranges = [(rng.choice(["a", "b", None]), s := rng.randint(1, 60), s + rng.randint(0, 20)) for _ in range(25)] + [("a", None, 3), ("a", 3, None), ("a", 5, 9), ("a", 5, 9)]
    spans = [(rng.choice(["a", "b", "c", None]), x := rng.randint(1, 80), x + rng.randint(-1, 10), k) for k in range(150)] + [("a", None, 2, 200), ("a", 2, None, 201), ("a", 6, 7, 202), ("a", 6, 7, 202)]
    df = spark.createDataFrame(spans, "file_path string, first_line int, last_line int, k int")
    out = asof.in_ranges(df, spark.createDataFrame(ranges, "file_path string, first_line int, last_line int"), block=block)
    assert out.columns == [*df.columns, "inside"]
    want = sorted(((f, a, b, k, a is not None and b is not None and any(g == f and s is not None and e is not None and s <= a and b <= e for g, s, e in ranges)) for f, a, b, k in spans), key=str)
    assert sorted(map(tuple, out.collect()), key=str) == want


def test_many_ranges_of_one_file(spark):
    """The time of 100,000 ranges and as many spans of one file, against a tenth of both."""

    def seconds(n):
        spans = spark.range(n).selectExpr("'a' AS file_path", "CAST(id * 7 % 1000003 AS INT) AS first_line", "CAST(id * 7 % 1000003 + 3 AS INT) AS last_line")
        ranges = spark.range(n).selectExpr("'a' AS file_path", "CAST(id * 11 % 1000003 AS INT) AS first_line", "CAST(id * 11 % 1000003 + id % 50 AS INT) AS last_line")
        began = time.time()
        assert asof.in_ranges(spans, ranges).filter("inside").count() > 0
        return time.time() - began

    seconds(1000)
    small = max(seconds(10_000), 1)
    assert seconds(100_000) < 8 * small


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_nearest_touched(spark, block):
    rng = random.Random(block + 5)
    touched = [(rng.choice(["a", "b", None]), rng.randint(1, 200)) for _ in range(30)] + [("a", None)]
    rows = [(rng.choice(["a", "b", "c", None]), rng.randint(1, 250), k) for k in range(120)] + [("a", None, 500)]
    df = spark.createDataFrame(rows, "file_path string, line int, k int")
    out = asof.nearest_touched(df, spark.createDataFrame(touched, "file_path string, line int"), block=block).collect()
    assert len(out) == len(rows)
    for r in out:
        away = [abs(t - r.line) for f, t in touched if f == r.file_path and t is not None] if r.line is not None else []
        assert r.distance == (min(away) if away else None) and r.near == (max(0.0, 100.0 * (1 - min(away) / 50)) if away else 50.0), r


# metrics by content


def test_a_second_run_computes_nothing(spark, tmp_path):
    store = incremental.MetricStore(str(tmp_path / "m"), keep=2)
    rows = [(f"f{k}.ts", f"if (a{k % 5}) {{ b(); }}\n" * (1 + k % 5)) for k in range(20)] + [("null.ts", None), ("empty.ts", ""), ("f0.ts", "twice")]
    files = spark.createDataFrame(rows, "file_path string, content string")
    plain = {(r.file_path, r.cyclomatic, r.lines_of_code) for r in rules.file_metrics(files.filter("content IS NOT NULL")).collect()}
    first = store.run(files, 1).collect()
    assert {(r.file_path, r.cyclomatic, r.lines_of_code) for r in first if r.cyclomatic is not None} == plain and len(first) == len(rows)
    assert store.computed(spark, 1) == 7
    second = store.run(files, 2).collect()
    assert sorted(map(str, second)) == sorted(map(str, first)) and store.computed(spark, 2) == 0
    assert sorted(map(str, store.run(files, 1).collect())) == sorted(map(str, first)), "a run that is done again"
    changed = files.filter("file_path <> 'f1.ts'").unionByName(spark.createDataFrame([("f1.ts", "new();")], files.schema))
    store.run(changed, 3)
    assert store.computed(spark, 3) == 1


def test_what_no_run_meets_is_forgotten(spark, tmp_path):
    store = incremental.MetricStore(str(tmp_path / "m"), keep=2)
    for n, names in enumerate([("a", "b"), ("a",), ("a", "c"), ("a",)]):
        store.run(spark.createDataFrame([(x, f"{x}();") for x in names], "file_path string, content string"), n)
    assert store.stored(spark).count() == 3
    store.expire(spark, 3)
    assert store.stored(spark).count() == 2, "b was met by run 0 only"
    store.run(spark.createDataFrame([(x, f"{x}();") for x in "abc"], "file_path string, content string"), 4)
    assert store.computed(spark, 4) == 1


# registered patterns


def test_a_hundred_patterns_are_one_scan(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(100)]
    texts = ["\n".join(" ".join(rng.choice([*words, "x", "// word1", "'word2'", "é"]) + rng.choice(["(", " ", "();"]) for _ in range(8)) for _ in range(12)) for _ in range(15)]
    files = spark.createDataFrame([(f"f{k}.ts", t) for k, t in enumerate(texts)], "file_path string, content string")
    every = Registry()
    for w in words:
        every.add_pattern(w, rf"\b{w}\b\s*\(", f"{w} is called")
    every.add_pattern("any", r"\bword\d+\(\)", "overlaps with the others").add_pattern("either", r"(?:x|é) ", "no literal")
    df = every.pattern_matches(files)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"LocalRelation|LogicalRDD", plan)) == 1 and "Union" not in plan
    got = sorted(map(tuple, df.select("file_path", "line", "col", "rule").collect()))
    want = []
    for name, regex, message, *_ in every.patterns:
        own = Registry().add_pattern(name, regex, message)
        want += map(tuple, own.pattern_matches(files).select("file_path", "line", "col", "rule").collect()) if name in ("any", "either", "word7", "word55") else []
    assert set(want) <= set(got) and len(want) == sum(r[3].split("/")[1] in ("any", "either", "word7", "word55") for r in got)
    counted = sum(len(re.findall(rf"\b{w}\b\s*\(", re.sub(r"//.*|'word2'", lambda m: "\x01" * len(m[0]), t))) for w in words for t in texts)
    assert counted == sum(re.fullmatch(r"sievecast/word\d+", r[3]) is not None for r in got)


@pytest.mark.parametrize(("regex", "literal"), [(r"\bfoo\(", "foo("), ("a|b", ""), (r"x(?:abc)?yz+", "x"), (r"[ab]cde", "cde"), (r"(?i)abc", ""), (r"ab{2}c", "a"), ("", ""), (r"(abc)def", "abcdef"), (r"\d+\.toFixed", ".toFixed")])
def test_required_literals(regex, literal):
    from sievecast.operators.registry import required_literal

    assert required_literal(regex) == literal


def test_registry_without_patterns(spark):
    files = spark.createDataFrame([("a.ts", "x")], "file_path string, content string")
    assert Registry().pattern_matches(files).count() == 0 and Registry().add_threshold("long", F.length, 0, "m").matches(files).count() == 1
