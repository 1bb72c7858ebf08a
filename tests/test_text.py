import random

import pytest
from pyspark.sql import functions as F

from sievecast.functions import mask, metrics, patterns, text
from sievecast.operators import rules, suppress, syntax


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "content string").select(column.alias("x")).first()["x"]


def scan(source):
    """A plain scanner of comments and literals: the text with them blanked."""
    out, i, state = [], 0, ""
    while i < len(source):
        two = source[i : i + 2]
        if not state:
            state = two if two in ("//", "/*") else source[i] if source[i] in "'\"`" else ""
            out.append("\x01" * len(state) if state else source[i])
            i += max(1, len(state))
        elif state == "//":
            out.append("\n" if source[i] == "\n" else "\x01")
            state = "" if source[i] == "\n" else state
            i += 1
        elif state == "/*":
            if two == "*/":
                out.append("\x01\x01")
                state, i = "", i + 2
            else:
                out.append("\n" if source[i] == "\n" else "\x01")
                i += 1
        elif source[i] == "\\" and i + 1 < len(source):
            out += ["\x01", "\n" if source[i + 1] == "\n" else "\x01"]
            i += 2
        else:
            out.append("\n" if source[i] == "\n" else "\x01")
            state = "" if source[i] == state else state
            i += 1
    return "".join(out)


def test_mask_matches_a_plain_scanner(spark):
    random.seed(1)
    texts = ["".join(random.choice(["//", "/*", "*/", "'", '"', "`", "\\", "\n", "a", " ", "{", "é"]) for _ in range(random.randint(0, 30))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "content string").select("content", mask.mask(F.col("content")).alias("m")).collect()
    assert all(r.m == scan(r.content) for r in rows)


@pytest.mark.parametrize(
    ("source", "cyclomatic", "cognitive", "nesting", "loc"),
    [
        ("", 1, 0, 0, 0),
        ("// if while {\n\"if {\"", 1, 0, 0, 1),
        ("if (x) { while (y) { if (z) { } } }", 4, 6, 3, 1),
        ("f(g(h(i())))", 1, 0, 0, 1),
        ("{}{}{}", 1, 0, 1, 1),
        ("obj?.foo?.bar?.baz", 1, 0, 0, 1),
        ("a ?? b ?? c", 1, 0, 0, 1),
        ("a ? b : c", 2, 0, 0, 1),
        ("// c\nlet a = 1;\n\nfunction f() {\n  return 1;\n}", 1, 0, 1, 4),
    ],
)
def test_metrics(spark, source, cyclomatic, cognitive, nesting, loc):
    r = rules.file_metrics(spark.createDataFrame([("a.ts", source)], "file_path string, content string")).first()
    assert (r.cyclomatic, r.cognitive, r.max_nesting, r.lines_of_code) == (cyclomatic, cognitive, nesting, loc)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("\n\ndebugger;", [("debugger", 3, 1)]),
        ("  debugger;", [("debugger", 1, 3)]),
        ("é debugger; debugger", [("debugger", 1, 4), ("debugger", 1, 14)]),
        ("console.log(1); console.foo(2); console.warn(3)", [("console-log", 1, 1), ("console-log", 1, 33)]),
        ("ctx.eval(x); arr?.eval(z); dialog.alert('hi')", []),
        ("eval /*c*/ (x)", []),
        ("foo.console.log(1)", [("console-log", 1, 5)]),
        ("try {} catch (e) {}", [("empty-catch", 1, 8)]),
        ("try {} catch (e) { log(e); }", []),
        ("try {} catch (f(g())) { /* why */ 'x' }", [("empty-catch", 1, 8)]),
        ("password = 'short'", []),
        ("PassWord: 'averyverylongsecret'", [("hardcoded-secret", 1, 1)]),
        ("notpassword = 'averyverylongsecret'", []),
        ("api_key = 'unterminated...", [("hardcoded-secret", 1, 1)]),
    ],
)
def test_patterns(spark, source, expected):
    hits = rules.pattern_hits(spark.createDataFrame([("a.ts", source)], "file_path string, content string")).collect()
    assert [(h.pattern, h.line, h.col) for h in hits] == expected


def test_stable_id(spark):
    files = spark.createDataFrame([("a.ts", "\ndebugger;")], "file_path string, content string")
    assert rules.all_matches(files).first().id == "sievecast/debugger-statement:a.ts:2:1"


def test_edit_matching(spark):
    c = F.col("content")
    assert one(spark, "a\r\nb", text.count_matches(c, F.lit("a\nb"))) == 1
    assert one(spark, "aaaa", text.count_matches(c, F.lit("aa"))) == 2
    assert one(spark, "aaaa", text.count_matches(c, F.lit(""))) == 0
    assert tuple(one(spark, "a\nb\nc\nd", text.match_range(c, F.lit("b\nc")))) == (2, 3)
    assert tuple(one(spark, "a\nb\nc", text.match_range(c, F.lit("b   ")))) == (2, 2)
    assert one(spark, "a", text.match_range(c, F.lit("z"))) is None
    assert one(spark, "\tx", text.correct_indentation(c, F.lit("  y\n    z"))) == "\ty\n\tz"


def test_entropy_and_hash(spark):
    assert one(spark, "aabb \n", metrics.byte_entropy("content")) == 1.0
    assert one(spark, "", metrics.byte_entropy("content")) == 0.0
    h = 5381
    for b in "aé".encode():
        h = (h * 33 + b) % 2**32
    assert one(spark, "aé", text.djb2(F.col("content"))) == h


def test_suppressions(spark):
    source = "debugger; // sievecast-disable-line no-eval, debugger-statement\n//\nsievecast-disable-next-line\neval(1)\ndebugger"
    files = spark.createDataFrame([("a.ts", source)], "file_path string, content string")
    found = suppress.parse_suppressions(files)
    assert {(r.scope, r.line, r.rule) for r in found.collect()} == {("line", 1, "no-eval"), ("line", 1, "debugger-statement"), ("line", 3, "*")}
    left = suppress.unsuppressed(rules.all_matches(files), found).collect()
    assert {(r.line, r.rule) for r in left} == {(4, "sievecast/eval-detected"), (5, "sievecast/debugger-statement")}


def test_syntax_rules(spark):
    source = "import { used, other as gone } from 'm';\nused(3500);\nel.innerHTML = x;\nfunction big(a, b, c, d, e, f) { if (1) { if (1) { if (1) { if (1) { if (1) {} } } } } }"
    files = spark.createDataFrame([("a.ts", source)], "file_path string, content string")
    found = {r.rule.split("/")[1] for r in syntax.all_rules(files).collect()}
    assert found == {"unused-import", "magic-number", "xss-innerhtml", "long-params", "deep-nesting"}


def long_params(spark, source):
    files = spark.createDataFrame([("a.ts", source)], "file_path string, content string")
    return [(r.line, r.col, r.message, r.severity) for r in syntax.long_parameter_lists(files).orderBy("line", "col").collect()]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("é();\n function far(\n" + ",\n".join(f"p{i}" for i in range(60)) + "\n) {}", [(2, 2, "far has 60 parameters", "error")]),
        ("x = (\n" + ",\n".join(f"p{i}" for i in range(60)) + ",\n) => 1", [(1, 5, "anonymous has 60 parameters", "error")]),
        ("class A { static *m(a, b, c, d, e, f) { g(1, 2, 3, 4, 5, 6); } }", [(1, 19, "m has 6 parameters", "warning")]),
        ("class A { über<T>(a: Map<T, T>, b, c, d, e, f): Promise<T> {} }", [(1, 11, "über has 6 parameters", "warning")]),
        ("function* g(a = h((1), 2), { b, c } = {}, d, e, f, i /* j, k */) {}", [(1, 1, "g has 6 parameters", "warning")]),
        ("(a: Map<string, number>, b, c, d, e) => 1; x ? h(1, 2, 3, 4, 5, 6) : {}; functional(1, 2, 3, 4, 5, 6)", []),
        ("class B extends mixin(1, 2, 3, 4, 5, 6) {}; for (a, b, c, d, e, f; ;) {}", []),
        ("f(async (a, b, c, d, e, f): Promise<number> => (g) => 1, function (a, b, c, d, e, f) {})", [(1, 9, "anonymous has 6 parameters", "warning"), (1, 58, "anonymous has 6 parameters", "warning")]),
    ],
)
def test_long_params(spark, source, expected):
    assert long_params(spark, source) == expected


def test_unused_names_of_long_imports(spark):
    source = "import {\n" + ",\n".join(f"name{i}" for i in range(60)) + "\n} from 'm';\nimport {\n kept as\n gone } from 'n';\nname7(name59);"
    files = spark.createDataFrame([("a.ts", source)], "file_path string, content string")
    found = {r.message.split()[0] for r in syntax.unused_imports(files).collect()}
    assert found == {f"name{i}" for i in range(60) if i not in (7, 59)} | {"gone"}


def test_registry(spark):
    from sievecast.operators.registry import Registry

    files = spark.createDataFrame([("a.ts", "todo(); // todo()")], "file_path string, content string")
    own = Registry().add_pattern("todo", r"\btodo\(", "left to do").add_threshold("long", F.length, 5, "too long")
    assert sorted(r.rule for r in own.matches(files).collect()) == ["sievecast/long", "sievecast/todo"]
    assert patterns.SECRET_WORDS


def test_change_summary(spark):
    cases = [("a\nb", "a\nb\nc", "+1 lines (3 → 5 bytes)"), ("a\nb\n", "a", "-2 lines (4 → 1 bytes)"), ("", "x", "±0 lines (0 → 1 bytes)"), ("é", "\U0001F600", "±0 lines (1 → 2 bytes)"), (None, "x", None)]
    rows = spark.createDataFrame(cases, "before string, after string, want string").select("want", text.change_summary(F.col("before"), F.col("after")).alias("have")).collect()
    assert [r.have for r in rows] == [r.want for r in rows]
