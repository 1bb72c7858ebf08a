"""Scanners of catches, line hashes and changed lines: plain values, no session but where a column is tested."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievecast.functions import catches, text
from sievecast.operators import diff

@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("try{f()}catch(e){ {} log(e); }", []),
        ("try{}catch{ }", [5]),
        ("try{}catch(f(g(h(i(j))))){ {{}} \x01\x01 }", [5]),
        ("catch(e){ try{}catch(x){} }", []),
        ("catch(e){", [0]),
        ("p.catch(e => {})", []),
        ("catch(e){} catch(e){a} catch(e)\n{\n}", [0, 23]),
    ],
)
def test_catches(source, expected):
    assert catches.scan(source) == expected


def plain_catches(source):
    """By hand over characters: words of braces and letters only."""
    out, i = [], 0
    while (at := source.find("catch", i)) >= 0:
        i = at + 5
        if source[max(0, at - 1) : at].isalpha() or source[i : i + 1].isalpha():
            continue
        while source[i : i + 1] == " ":
            i += 1
        if source[i : i + 1] != "{":
            continue
        depth, code, i = 1, False, i + 1
        while i < len(source) and depth:
            c = source[i]
            depth += (c == "{") - (c == "}")
            code |= c not in "{} "
            i += 1
        if not code:
            out.append(at)
    return out


def test_catches_match_a_plain_scanner():
    random.seed(3)
    for _ in range(2000):
        source = "".join(random.choice(["catch", "{", "}", " ", "x", "{}"]) for _ in range(random.randint(0, 14)))
        assert catches.scan(source.replace("x", "+")) == plain_catches(source.replace("x", "+")), source


def test_line_hashes(spark):
    lines = ["", "a", "some line of code();", "é" * 5, "x" * 3000]

    def plain(line):
        data = line.encode()
        h = 5381
        for i in range(len(data)):
            for b in data[i:]:
                h = (h * 33 + b) % 2**32
        return h

    df = spark.createDataFrame([(x,) for x in lines], "content string")
    assert [r.h for r in df.select(text.hash_lines(F.col("content"), 1, 1).alias("h")).collect()] == [plain(x) for x in lines]


def test_changed_lines_cost_their_number():
    run = diff.changed_line_numbers.func
    old = pd.Series(["\n".join(f"a{i}" for i in range(n)) for n in (100_000, 200_000)])
    new = pd.Series(["\n".join(f"b{i}" for i in range(n)) for n in (100_000, 200_000)])
    began = time.time()
    assert [len(x) for x in run(old, new)] == [100_000, 200_000] and time.time() - began < 5
    assert list(run(pd.Series(["a\nb", "", None, "x"]), pd.Series(["b\nc\na", "\nq", "z\n", None]))) == [[2], [2], [1], None]


def test_new_lint_in_one_read_of_the_diagnostics(spark):
    """New files and files without an edit keep all; others what has no line or is on a changed one. Repeated rows and null lines stay."""
    from sievecast.operators import diff

    edits = spark.createDataFrame([("new", "", "a\nb"), ("old", "a\nb\nc", "a\nx\nc"), ("old", "a\nb\nc", "a\nb\ny"), ("gone", "a", None), ("both", None, "q"), ("both", "p", "p\nr")], "file_path string, before string, after string")
    rows = [("new", 1), ("new", 9), ("other", 5), ("other", None), ("old", 1), ("old", 2), ("old", 2), ("old", 3), ("old", 0), ("old", None), ("gone", 1), ("gone", 0), ("both", 1), ("both", 2), ("both", 3), (None, 1)]
    diagnostics = spark.createDataFrame([(*r, "m") for r in rows], "file_path string, line int, message string")
    got = diff.new_lint(diagnostics, edits)
    dropped = [("old", 1), ("gone", 1), ("both", 3)]
    assert got.columns == diagnostics.columns
    assert sorted(map(str, [(r.file_path, r.line) for r in got.collect()])) == sorted(map(str, [r for r in rows if r not in dropped]))
    reads = diff.new_lint(diagnostics, edits)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert reads <= 3
