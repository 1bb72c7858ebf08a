"""Syntax trees, the rules over them, and queries."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from sievecast.functions import syntax_tree
from sievecast.operators import ast_query, syntax

DDL = "file_path string, content string"


def found(spark, source, rule):
    """Line, column and what the message says of one rule's matches."""
    files = spark.createDataFrame([("a.ts", source)], DDL)
    rows = {"danger": syntax.dangerous_calls, "import": syntax.unused_imports, "nesting": syntax.deep_blocks, "number": syntax.magic_numbers}[rule](files).collect()
    assert all(r.snippet == source.split("\n")[r.line - 1].strip() for r in rows)
    short = {"danger": lambda r: r.rule.split("/")[1], "import": lambda r: r.message.split()[0], "nesting": lambda r: int(r.message.split()[-1]), "number": lambda r: r.message.split()[-1]}[rule]
    return [(r.line, r.col, short(r)) for r in rows]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("const exec = 1; let system = 2; eval = 3", []),
        ("eval(x); a.exec(y); el.innerHTML = z; el.innerHTML == z; el.innerHTML += z", [(1, 1, "eval-detected"), (1, 12, "shell-exec"), (1, 24, "xss-innerhtml")]),
        ("eval(system(x)); a.b(eval(1)).exec(q)", [(1, 1, "eval-detected"), (1, 31, "shell-exec")]),
        ("el.innerHTML = eval(x)\nsystem(y)", [(1, 4, "xss-innerhtml"), (2, 1, "shell-system")]),
        ("class A { exec(a) { return 1 } }\nfunction eval(x) {}\nnew system()", []),
        ("// eval(x)\n'eval(1)'; `eval(2) ${eval(3)}`; /eval(4)/.test(a)", [(2, 23, "eval-detected")]),
        ("a.exec(b)(c); eval?.(d); x(eval)", [(1, 3, "shell-exec"), (1, 15, "eval-detected")]),
    ],
)
def test_dangerous(spark, source, expected):
    assert found(spark, source, "danger") == expected


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("import {\n a,\n b as c,\n type D\n} from 'm';\nimport x, * as ns from 'n';\nimport 'o';\nfoo(a); o.c; import('p')", [(6, 8, "x"), (3, 7, "c"), (4, 7, "D")]),
        ("import { a, b } from 'm';\nlog(`v ${a} ${ {k: `${b}`} }`)", []),
        ("import { a, b, c } from 'm';\nx = {a: 1, b}; o.c", [(1, 10, "a"), (1, 16, "c")]),
        ("import { T, U } from 'm';\nlet x: T = f<U>(1)", []),
        ("import a from 'm'\nimport b from 'n'\nb()", [(1, 8, "a")]),
        ("import { foo, bar } from 'module';\nfoo();", [(1, 15, "bar")]),
        ("import React from 'react';\nconst x = 1;", [(1, 8, "React")]),
        ("import { a } from 'm'; import { a } from 'n'", [(1, 10, "a")]),
    ],
)
def test_imports(spark, source, expected):
    assert sorted(found(spark, source, "import")) == sorted(expected)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("if (1) { if (1) { if (1) { if (1) { if (1) {} } } } }", [(1, 37, 5)]),
        ("if(a){}else if(b){}else if(c){}else{}", [(1, 25, 5), (1, 32, 6)]),
        ("x = {a: {b: {c: {d: {e: {f: 1}}}}}}", []),
        ("const f = (a) => { return (b) => c => d => (e, g) => 3 }", [(1, 44, 5)]),
        ("try { for (;;) while (1) do { switch (a) { case 1: b(); } } while (c) } catch { f(function () {}) } finally {}", [(1, 31, 5)]),
    ],
)
def test_nesting(spark, source, expected):
    assert found(spark, source, "nesting") == expected


def test_numbers(spark):
    source = "let a=3500, b=[10,20], c=0x10, e=1.0, g=a[12]; for(let i=10;i<20;i++){z(30)} enum E { A = 10 } export const q = 55; y(77)"
    assert [n for *_, n in found(spark, source, "number")] == ["3500", "0x10", "12", "77"]
    source = "f(.75); let a: Array<20>; new Foo<13>(); type T = [44, 45]; x(0x1, 1e0, .5, -33, 1_000); g<22>(y); h(a < 23)"
    assert found(spark, source, "number") == [(1, source.index(n) + 1, n) for n in (".75", "33", "1_000", "23")]


def test_deep_sources_lose_nothing(spark):
    deep = "import { gone } from 'm';\n" + "if (a) {" * 10_000 + " eval(3500) " + "}" * 10_000
    files = spark.createDataFrame([("deep.ts", deep), ("flat.ts", "eval(1)"), ("none.ts", None), ("empty.ts", "")], DDL)
    counts = {(r.file_path, r.rule.split("/")[1]): r["count"] for r in syntax.all_rules(files).groupBy("file_path", "rule").count().collect()}
    assert counts == {("deep.ts", "unused-import"): 1, ("deep.ts", "deep-nesting"): 9_996, ("deep.ts", "eval-detected"): 1, ("deep.ts", "magic-number"): 1, ("flat.ts", "eval-detected"): 1}
    assert syntax.failures(files).count() == 0


def test_a_source_that_fails_is_a_row_of_its_own(spark, monkeypatch):
    limit = sys.getrecursionlimit()
    run = syntax_tree.tree
    seen = []

    def failing(source, kinds=None):
        seen.append(kinds)
        return F.when(source.contains("bad"), F.struct(F.lit(None).cast(f"array<{syntax_tree.NODE}>").alias("nodes"), F.lit("RecursionError: 3 characters").alias("error"))).otherwise(run(source, kinds))

    monkeypatch.setattr(syntax, "tree", failing)
    files = spark.createDataFrame([("bad.ts", "bad"), ("good.ts", "eval(1)")], DDL)
    assert [(r.file_path, r.error) for r in syntax.failures(files).collect()] == [("bad.ts", "RecursionError: 3 characters")]
    assert [r.file_path for r in syntax.all_rules(files).collect()] == ["good.ts"] and seen and sys.getrecursionlimit() == limit


# random sources, made with the tree that they must have


class Maker:
    """Writes a random nested source and, by plain recursion, what a walk of it has to find."""

    def __init__(self, seed):
        self.random, self.source, self.nesting, self.calls, self.names = random.Random(seed), "", [], [], 0

    def put(self, text):
        self.source += text

    def gap(self):
        self.put(self.random.choice((" ", "\n", " /* if (a) { */ ", " // } eval(1)\n", "")))

    def place(self):
        line = self.source.count("\n")
        return line + 1, len(self.source.encode()) - (len(self.source[: self.source.rfind("\n") + 1].encode()))+ 1

    def expression(self, depth, level):
        kind = self.random.randrange(9 if depth else 3)
        if kind == 0:
            self.put(self.random.choice(("a", "bé", "x1")))
        elif kind == 1:
            self.put(self.random.choice(("'it } {'", '"a\\"("', "/[/}]{2}/g.y", "7")))
        elif kind == 2:
            self.put("`t ${")
            self.expression(max(depth - 1, 0), level)
            self.put("} } `")
        elif kind == 3:
            self.names += 1
            self.calls.append((*self.place(), f"f{self.names}"))
            self.put(f"f{self.names}(")
            self.expression(depth - 1, level)
            self.put(", ")
            self.expression(depth - 1, level)
            self.put(")")
        elif kind == 4:
            self.nesting.append((*self.place(), level + 1, "arrow_function"))
            self.put("(p, q = 1) => {")
            self.statement(depth - 1, level + 1)
            self.put("}")
        elif kind == 5:
            self.put("{ k: ")
            self.expression(depth - 1, level)
            self.put(", m() {")
            self.statement(depth - 1, level)
            self.put("} }")
        elif kind == 6:
            self.put("(a ? ")
            self.expression(depth - 1, level)
            self.put(" : ")
            self.expression(depth - 1, level)
            self.put(")")
        elif kind == 7:
            self.nesting.append((*self.place(), level + 1, "function_expression"))
            self.put("function () {")
            self.statement(depth - 1, level + 1)
            self.put("}")
        else:
            self.put("[")
            self.expression(depth - 1, level)
            self.put(" + a / 2, ...")
            self.expression(depth - 1, level)
            self.put("]")

    def statement(self, depth, level):
        for _ in range(self.random.randint(1, 2)):
            kind = self.random.randrange(7 if depth else 1)
            self.gap()
            if kind == 0:
                self.put("v = ")
                self.expression(depth, level)
                self.put(";")
            elif kind == 1:
                self.nesting.append((*self.place(), level + 1, "if_statement"))
                self.put("if (a > 1) {")
                self.statement(depth - 1, level + 1)
                self.put("}")
                if self.random.random() < 0.5:
                    self.put(" ")
                    self.nesting.append((*self.place(), level + 2, "else_clause"))
                    self.put("else {")
                    self.statement(depth - 1, level + 2)
                    self.put("}")
            elif kind == 2:
                self.nesting.append((*self.place(), level + 1, "while_statement"))
                self.put("while (")
                self.expression(depth - 1, level + 1)
                self.put(") {")
                self.statement(depth - 1, level + 1)
                self.put("}")
            elif kind == 3:
                self.nesting.append((*self.place(), level + 1, "for_statement"))
                self.put("for (let i = 0; i < 3; i++) {")
                self.statement(depth - 1, level + 1)
                self.put("}")
            elif kind == 4:
                self.nesting.append((*self.place(), level + 1, "try_statement"))
                self.put("try {")
                self.statement(depth - 1, level + 1)
                self.put("} ")
                self.nesting.append((*self.place(), level + 2, "catch_clause"))
                self.put("catch (e) {")
                self.statement(depth - 1, level + 2)
                self.put("}")
            elif kind == 5:
                self.nesting.append((*self.place(), level + 1, "function_declaration"))
                self.put("function g(a: Map<string, number>, b?: T[]) {")
                self.statement(depth - 1, level + 1)
                self.put("}")
            else:
                self.put("class C<T> extends D { private x = ")
                self.expression(depth - 1, level)
                self.put("; m(y: number): void {")
                self.statement(depth - 1, level)
                self.put("} }")


def test_random_sources_agree_with_a_plain_walk():
    for seed in range(150):
        m = Maker(seed)
        m.statement(4, 0)
        rows = [dict(zip(syntax_tree.FIELDS, r, strict=True)) for r in syntax_tree.nodes(m.source)]
        assert not [r for r in rows if r["type"] == "ERROR"], m.source
        assert sorted((r["line"], r["col"], r["nesting"], r["type"]) for r in rows if r["type"] in syntax_tree.NESTING) == sorted(m.nesting), m.source
        assert sorted((r["line"], r["col"], r["name"]) for r in rows if r["type"] == "call_expression" and r["name"][0] == "f") == sorted(m.calls), m.source


def test_intervals_and_parents():
    m = Maker(7)
    m.statement(5, 0)
    rows = [dict(zip(syntax_tree.FIELDS, r, strict=True)) for r in syntax_tree.nodes(m.source)]
    by = {r["pre"]: r for r in rows}
    assert [r["pre"] for r in rows] == list(range(len(rows))) and rows[0]["type"] == "program"
    for r in rows[1:]:
        up = by[r["parent"]]
        assert up["pre"] < r["pre"] <= r["last"] <= up["last"] and r["depth"] == up["depth"] + 1
        above, bits = up, 0
        while above is not None:
            bits |= 1 << syntax_tree.UNDER.index(above["type"]) if above["type"] in syntax_tree.UNDER else 0
            above = by.get(above["parent"])
        assert r["under"] == bits
    assert all(r["kids"] == sum(x["parent"] == r["pre"] for x in rows) for r in rows)


@pytest.mark.parametrize("source", ["}}}", "if (", "((((", "`${", "`${a", "class {", "function (", "import {", "export", "a ? b", "x = {a:", "@", "#", "<<<", "enum E {", "switch (a) { case", "for (;;", "({[", ") => {", "type X =", "'", "/", "interface", "\x00", "𝄞 = 1"])
def test_broken_sources_end(source):
    assert syntax_tree.nodes(source)[0][4] == "program"
    rng = random.Random(source)
    for _ in range(40):
        text = "".join(rng.choice(["{", "}", "(", ")", "[", "]", "`", "${", "if", "else", " ", "a", "=>", ",", ";", ":", "?", "<", ">", "=", "class", "function", "import", "for", "'", "/", "\n", ".", "12", "...", "async", "type", "case", "new"]) for _ in range(rng.randint(0, 60)))
        rows = syntax_tree.nodes(text)
        assert rows[0][4] == "program" and rows[0][1] == len(rows) - 1


def test_node_table_and_table_function(spark):
    files = spark.createDataFrame([("a.ts", "if (x) {\n  f(1) }"), ("b.ts", None), ("c.ts", "")], DDL)
    rows = syntax.node_table(files).collect()
    assert {r.file_path for r in rows} == {"a.ts", "c.ts"} and {r.snippet for r in rows if r.type == "call_expression"} == {"f(1) }"}
    assert [r.type for r in syntax.node_table(files, ("number",)).collect()] == ["number"]
    files.createOrReplaceTempView("sources_of_test")
    syntax.register(spark)
    got = spark.sql("SELECT file_path, n.pre, n.type, n.line FROM sources_of_test, LATERAL syntax_nodes(content) AS n").collect()
    spark.catalog.dropTempView("sources_of_test")
    assert sorted(map(tuple, got)) == sorted((r.file_path, r.pre, r.type, r.line) for r in rows)


def test_contained(spark):
    files = spark.createDataFrame([("a.ts", "function f() { g(1) }\nh(2)\nfunction i() { if (a) { j(3) } }"), ("b.ts", "k(4)")], DDL)
    calls = syntax.contained(syntax.node_table(files), "function_declaration").filter("type = 'call_expression'")
    assert sorted(r.name for r in calls.collect()) == ["g", "j"]


# queries


def captures(spark, source, query):
    nodes = syntax.node_table(spark.createDataFrame([("a.ts", source)], DDL))
    return [(r.capture, r.line, r.col, r.name) for r in ast_query.run_query(nodes, query).orderBy("pattern", "match", "capture", "line", "col").collect()]


@pytest.mark.parametrize(
    ("source", "query", "expected"),
    [
        ("eval(x);\nf(y)", "(call_expression function: (identifier) @fn)", [("fn", 1, 1, "eval"), ("fn", 2, 1, "f")]),
        ("eval(x);\nf(y)", '(call_expression function: (identifier) @fn (#eq? @fn "eval"))', [("fn", 1, 1, "eval")]),
        ("a.b(1); c.d = 2", "(member_expression object: (_) @o property: (property_identifier) @p)", [("o", 1, 1, "a"), ("p", 1, 3, "b"), ("o", 1, 9, "c"), ("p", 1, 11, "d")]),
        ("a.log(1); b.warn(2)", '(call_expression function: (member_expression property: (property_identifier) @p) (#match? @p "^w"))', [("p", 1, 13, "warn")]),
        ("f(1); f(g(2))", "(arguments (call_expression) @inner)", [("inner", 1, 9, "g")]),
        ("f(a, 1); f(1, a)", "(arguments (identifier) @x (number) @y)", [("x", 1, 3, "a"), ("y", 1, 6, "1")]),
        ("for (;;) {} while (1) {} if (2) {}", "[(for_statement) (while_statement)] @loop", [("loop", 1, 1, None), ("loop", 1, 13, None)]),
        ("f; function g() {}", "(identifier) @ref", [("ref", 1, 1, "f"), ("ref", 1, 13, "g")]),
        ("if (a) {} else {}\nif (b) {}", "(if_statement !alternative) @plain", [("plain", 2, 1, None)]),
        ("x = x; y = z", "(assignment_expression left: (identifier) @l right: (identifier) @r (#eq? @l @r))", [("l", 1, 1, "x"), ("r", 1, 5, "x")]),
        ("function f() { return 1 } function g() {}", "(function_declaration name: (identifier) @n body: (statement_block (return_statement)? @r))", [("n", 1, 10, "f"), ("r", 1, 16, None), ("n", 1, 36, "g")]),
        ("a(1)", '(number) @n (identifier) @i ; two patterns\n(#any-of? @i "a" "b")', [("n", 1, 3, "1"), ("i", 1, 1, "a")]),
        ("a(1)", "(string) @s", []),
        ("a(1)", "(call_expression)", []),
    ],
)
def test_queries(spark, source, query, expected):
    got = captures(spark, source, query)
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("query", ["", "(", "(a", "a)", "(a) @x (#eq? @y \"z\")", "(a . (b))", "(a)*", '"if"', "(#eq? @a \"b\")", "[]", "(a (#foo? @a))", "&"])
def test_queries_that_cannot_be_read(query):
    with pytest.raises(ast_query.QueryError):
        ast_query.compile_query(query)


def test_rules_of_queries(spark):
    files = spark.createDataFrame([("a.ts", "  eval(x);"), ("b.ts", "f(1)")], DDL)
    rules = [
        ast_query.AstRule("one", '(call_expression function: (identifier) @f (#eq? @f "eval"))', "no eval", "error", "own/eval", "use JSON"),
        ast_query.AstRule("broken", "(call_expression", "x", "info", "own/x"),
        ast_query.AstRule("other", "(call) @c", "x", "info", "own/y", language="python"),
    ]
    found_, errors = ast_query.run_rules(syntax.node_table(files), rules)
    assert [tuple(r) for r in found_.collect()] == [("own/eval:a.ts:1:3", "own/eval", "no eval", "error", "a.ts", 1, 3, "eval(x);", "use JSON")]
    assert [r.id for r in errors.collect()] == ["broken"]
