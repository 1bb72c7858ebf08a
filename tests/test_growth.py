"""What must hold as tables grow: no derived text or line is broadcast, whatever Spark takes their size for."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from compare import SMALL
from pyspark.sql import functions as F

from sievecast.functions import catches, metrics, syntax_tree
from sievecast.operators import ast_query, diff, lifecycle, rules, syntax
from sievecast.plans import queries


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snippets_broadcast_no_texts(spark):
    files = spark.createDataFrame([("a", "x\n  y  \n"), ("b", None)], "file_path string, content string")
    findings = spark.createDataFrame([("a", 2), ("a", 0), ("a", 9), ("b", 1), ("c", 1)], "file_path string, line int")
    got = lifecycle.with_snippets(findings, files)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2, "  y"), ("a", 0, None), ("a", 9, None), ("b", 1, None), ("c", 1, None)], key=str)
    assert "Broadcast" not in planned(queries.QUERIES["finding_snippets"](spark, SMALL))


@pytest.mark.parametrize("name", ["lint_new", "new_matches", "preexisting_count"])
def test_edits_broadcast_no_lines(spark, name):
    plan = planned(queries.QUERIES[name](spark, SMALL))
    wide = [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "file_path" in x]
    assert not wide, wide


def test_changed_lines_by_blocks(spark):
    random.seed(3)
    text = lambda n: "\n".join(random.choice("abcdefgh") * random.randint(0, 3) for _ in range(n))
    rows = [(f"f{k % 7}", random.choice([None, "", text(random.randint(1, 20)), text(300)]), random.choice([None, text(random.randint(1, 400))])) for k in range(30)]
    edits = spark.createDataFrame(rows, "file_path string, before string, after string")
    changed, edited = set(), {f for f, b, _ in rows if b}
    for f, b, a in rows:
        known = set(b.split("\n")) if b else {""}
        changed |= {(f, k) for k, x in enumerate((a or "").split("\n") if a is not None else [], 1) if x not in known}
    places = [(f"f{f}", line) for f in range(8) for line in [*range(0, 420), -1, -64, None] for _ in range(1 + (line == 64))]
    found = spark.createDataFrame(places, "file_path string, line int").withColumn("rule", F.lit("r"))
    of = lambda df: Counter((r.file_path, r.line) for r in df.collect())
    assert of(diff.new_matches(found.filter("line > 0"), edits, found.filter("false"))) == Counter(p for p in places if p in changed)
    assert of(diff.new_lint(found, edits)) == Counter(p for p in places if p in changed or not p[1] or p[0] not in edited)
    old = Counter(f for f, line in places if line and line > 0 and (f, line) not in changed)
    assert {r.file_path: r.n_preexisting for r in diff.preexisting_counts(found, edits).collect()} == old
    whole = spark.createDataFrame([("f1", 0, "r"), ("f1", 0, "s"), ("f9", 0, "r"), ("f1", 0, None), ("f1", None, "r")], "file_path string, line int, rule string")
    fired = spark.createDataFrame([("f1", "r"), ("f1", "r"), ("f2", "s"), ("f1", None)], "file_path string, rule string")
    assert sorted(map(tuple, diff.new_matches(whole, edits, fired).collect()), key=str) == sorted([("f1", 0, "s"), ("f9", 0, "r"), ("f1", 0, None)], key=str)


def test_new_matches_are_made_once(spark):
    files = spark.createDataFrame([("a", "eval(x)")], "file_path string, content string")
    found = rules.pattern_hits(files).withColumn("rule", F.col("pattern"))
    edits = spark.createDataFrame([("a", "", "eval(x)")], "file_path string, before string, after string")
    out = diff.new_matches(found, edits, found.filter("false"))
    assert out.count() == 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


LINES = ["if (q || r) { s(); }", "else { t(); }", "foo(1, 2);", "foo()", "(a) => b", "`t`", "`t ${a} u`", "return", "x = {", "a: 1,", "};", "}", "{", "function f(a, b) {", "class A {", "m(x: T): U { y(); }", "try { f(); } catch (e) { }", "catch (e) { }", "const g = (a: number): string => { return h(a) };", "/* c", "*/", "// d", "", "/re/.test(x);", "a / b / c;", '"s\\', "`u", "${v}", "w`;", "if (a)", "let q =", "+ 2", "++i;", "declare", "f(() => {", "});", "eval(1); console.log('é');"]


def test_lines_met_before_are_as_if_new():
    rng = random.Random(5)
    kinds = frozenset(("call_expression", "identifier", "statement_block"))
    for k in range(1500):
        some = rng.sample(LINES, rng.randint(2, 12))
        source = "\n".join(rng.choice(["", "  "]) + rng.choice(some) + rng.choice(["", "", " // c"]) for _ in range(rng.randint(0, 25)))
        wanted = kinds if k % 2 else None
        got = syntax_tree.nodes(source, wanted)
        arrays = syntax_tree._trees(pa.array([source, None]), wanted).to_pylist()
        assert [list(n.values()) for n in arrays[0]["nodes"]] == got and arrays[1]["nodes"] is None
        known = dict(syntax_tree._LINES)
        syntax_tree._LINES.clear()
        assert syntax_tree.nodes(source, wanted) == got, source
        syntax_tree._LINES.update(known)


def test_lines_are_read_once(monkeypatch):
    reads = []
    statement = syntax_tree._Parser.if_statement
    monkeypatch.setitem(syntax_tree._Parser.STATEMENTS, "if", lambda self: reads.append(1) or statement(self))
    source = "if (q || zz) { s(); }\n" * 500
    assert sum(n[4] == "if_statement" for n in syntax_tree.nodes(source)) == 500 and len(reads) < 10


def test_nothing_of_a_last_comment_is_code():
    for end in ("\n", " // eval(x)", " /* eval(x) */", "\n/* eval(x)"):
        assert [n[4] for n in syntax_tree.nodes("a;" + end)] == ["program", "expression_statement", "identifier"]


@pytest.mark.parametrize("name", ["ast_query_captures", "ast_query_rules"])
def test_tree_queries_broadcast_no_nodes_and_parse_once(spark, name):
    plan = planned(queries.QUERIES[name](spark, SMALL))
    spark.catalog.clearCache()
    assert "BroadcastHashJoin" not in plan and "InMemoryTableScan" in plan


QUERIES = [
    "(call_expression function: (identifier) @f arguments: (arguments (number) @n))",
    "(function_declaration name: (identifier) @n body: (statement_block (return_statement)? @r))",
    "(if_statement !alternative) @plain",
    "(arguments (_) @x (number)? @y)",
    "(binary_expression (identifier)? @o (member_expression object: (identifier) @i))",
    "[(for_statement) (while_statement)] @loop (number) @n",
    "(try_statement handler: (catch_clause body: (statement_block) @b) !finalizer)",
]


def test_nodes_that_fit_find_what_all_nodes_find(spark):
    rng = random.Random(11)
    bits = ["f(1);", "f(a, 2);", "g(h(3), 4);", "if (a) { f(5) } else { g(6) }", "if (b) f(7);", "function k() { return 8 }", "function l() { m() }", "x = a + b.c;", "y = b.c + 9;", "for (;;) { f(1, 2) }", "try { f() } catch (e) { }", "try { } catch { } finally { }"]
    files = spark.createDataFrame([(f"f{k}", "\n".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(25)] + [("none", None)], "file_path string, content string")
    everything = syntax.node_table(files).persist()
    for q in QUERIES:
        some = ast_query.node_table(files, q, "(unread").persist()
        of = lambda nodes, q=q: Counter(map(tuple, ast_query.run_query(nodes, q).collect()))
        assert of(some) == of(everything) != Counter(), q
        assert some.count() < everything.count() / 2
    spark.catalog.clearCache()


def test_tokens_are_those_that_metrics_count(spark):
    source = "éif (xif ? a : b) { while (ifx && y || z??.w) { foo(bar, case_); } } ifé $for for"
    got = spark.createDataFrame([(source,)], "m string").select(metrics.code_tokens(F.col("m")).alias("t")).first()["t"]
    assert got == ["if", "?", "{", "while", "&&", "||", "??.", "{", "}", "}", "if", "for"]


def test_only_catches_are_scanned(monkeypatch):
    looked = []

    class Counting:
        def search(self, text, at):
            looked.append(at)
            return token.search(text, at)

    token = catches._TOKEN
    monkeypatch.setattr(catches, "_TOKEN", Counting())
    text = "x = f(a, b);\n" * 200 + "catch (e) { }\n" + "y = g(c);\n" * 200
    assert catches.scan(text) == [2600] and len(looked) < 12
