"""Rules of syntax as columns over the nodes of a source's tree: imports, nesting, dangerous calls, numbers, parameter lists.

A file's nodes are an array in its row, made once for all rules; no rule shuffles. :func:`node_table` has them as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.syntax_tree import NESTING, NODE, UNDER, nodes, tree

#: Name, rule, message, severity, fix.
DANGEROUS = (
    ("eval", "eval-detected", "eval() executes arbitrary code", "error", "Use JSON.parse or a safe template engine."),
    ("exec", "shell-exec", "child_process.exec uses shell (injection risk)", "error", "Use execFile or spawn instead — they don't invoke a shell."),
    ("innerHTML", "xss-innerhtml", "innerHTML is vulnerable to XSS", "warning", "Use textContent or a sanitization library like DOMPurify."),
    ("outerHTML", "xss-outerhtml", "outerHTML is vulnerable to XSS", "warning", "Use textContent or a sanitization library like DOMPurify."),
    ("system", "shell-system", "system() executes shell commands (injection risk)", "error", "Use a parameterized subprocess API."),
    ("documentWrite", "xss-document-write", "document.write is vulnerable to XSS and breaks CSP", "warning", "Use DOM manipulation APIs instead."),
)
WARNING_DEPTH, ERROR_DEPTH, WARNING_PARAMETERS, ERROR_PARAMETERS = 4, 6, 5, 8
_COLUMNS = ("file_path", "line", "col", "rule", "message", "severity", "snippet", "fix")
_NAMES = ("identifier", "type_identifier", "shorthand_property_identifier")
_FUNCTIONS = ("function_declaration", "function_expression", "arrow_function", "method_definition")
#: Types in which a number is no magic one.
_NUMBERS_ALLOWED = ("enum_declaration", "array", "for_statement", "export_statement", "type_annotation", "type_arguments", "type_parameters", "type_alias_declaration", "interface_declaration")
_KINDS = {
    "imports": ("import_specifier", "import_clause", *_NAMES),
    "nesting": tuple(sorted(NESTING)),
    "danger": ("call_expression", "assignment_expression"),
    "numbers": ("number",),
    "parameters": ("formal_parameters", *_FUNCTIONS),
}
_lit = F.lit


def _inside(node: Column, *types: str) -> Column:
    """Whether a node stands in one of some types."""
    return node["under"].bitwiseAND(_lit(sum(1 << UNDER.index(t) for t in types)).cast("long")) != 0


def _only(found: Column, *types: str) -> Column:
    return F.filter(found, lambda n: n["type"].isin(*types))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where a lambda would compute it for each element."""
    return F.get(F.transform(F.array(value), body), _lit(0))


def _match(line: Column, col: Column, rule: Column, message: Column, severity: Column, fix: Column) -> Column:
    return F.struct(line.alias("line"), col.alias("col"), rule.alias("rule"), message.alias("message"), severity.alias("severity"), fix.alias("fix"))


def imports_rule(found: Column) -> Column:
    """Local names of default and named imports that nothing outside of imports names: no name, type or shorthand property. Names of members and properties are none; of equal imports the first counts; namespace and dynamic imports are left out."""
    clauses = F.transform(_only(found, "import_clause"), lambda n: n["pre"])
    local = lambda c: F.filter(found, lambda n: (n["type"] == "import_specifier") | ((n["type"] == "identifier") & _inside(n, "import_statement") & F.array_contains(c, n["parent"])))
    used = F.transform(F.filter(found, lambda n: n["type"].isin(*_NAMES) & ~_inside(n, "import_statement")), lambda n: n["name"])

    def unused(x: Column) -> Column:
        kept = F.filter(x["own"], lambda n, i: F.array_contains(x["unused"], n["name"]) & (F.array_position(x["names"], n["name"]) == i + 1))
        return F.transform(kept, lambda n: _match(n["name_line"], n["name_col"], _lit("unused-import"), F.concat(n["name"], _lit(" is imported and not used")), _lit("info"), F.concat(_lit("Remove the import of "), n["name"], _lit("."))))

    named = lambda own: _let(F.transform(own, lambda n: n["name"]), lambda names: F.struct(own.alias("own"), names.alias("names"), F.array_except(names, used).alias("unused")))
    return _let(_let(_let(clauses, local), named), unused)


def nesting_rule(found: Column) -> Column:
    """Control structures and functions that stand more than WARNING_DEPTH deep in others. An else, catch or finally is one level below its if or try."""
    deep = F.filter(found, lambda n: n["type"].isin(*sorted(NESTING)) & (n["nesting"] > WARNING_DEPTH))
    return F.transform(deep, lambda n: _match(n["line"], n["col"], _lit("deep-nesting"), F.concat(_lit("nesting depth "), n["nesting"].cast("string")), F.when(n["nesting"] > ERROR_DEPTH, "error").otherwise("warning"), _lit("Extract the nested logic into a separate function.")))


def danger_rule(found: Column) -> Column:
    """Calls of the names of the table, plain or as members, and assignments to such members; what stands in a match is part of it."""
    own = F.filter(found, lambda n: n["type"].isin("call_expression", "assignment_expression") & n["name"].isin(*[d[0] for d in DANGEROUS]))
    begin = F.struct(_lit(-1).alias("last"), F.array().cast("array<int>").alias("kept"))
    outer = F.aggregate(own, begin, lambda s, n: F.when(n["pre"] > s["last"], F.struct(n["last"].alias("last"), F.concat(s["kept"], F.array(n["pre"])).alias("kept"))).otherwise(s))["kept"]
    kept = _let(outer, lambda o: F.filter(own, lambda n: F.array_contains(o, n["pre"])))
    spec = F.create_map(*[x for d, r, m, s, f in DANGEROUS for x in (_lit(d), F.struct(_lit(r).alias("rule"), _lit(m).alias("message"), _lit(s).alias("severity"), _lit(f).alias("fix")))])
    return F.transform(kept, lambda n: _let(F.element_at(spec, n["name"]), lambda d: _match(n["name_line"], n["name_col"], d["rule"], d["message"], d["severity"], d["fix"])))


def numbers_rule(found: Column) -> Column:
    """Numbers of more than one digit but 0 and 1, outside of array literals, for loops, enums, exports and types."""
    name = lambda n: n["name"]
    plain = lambda n: F.coalesce(name(n).try_cast("double").isin(0.0, 1.0), _lit(False)) | name(n).rlike("^0[xXbBoO]0*[01]$") | (F.length(F.regexp_replace(name(n), "[-.]", "")) <= 1)
    magic = F.filter(found, lambda n: (n["type"] == "number") & ~_inside(n, *_NUMBERS_ALLOWED) & ~plain(n))
    return F.transform(magic, lambda n: _match(n["line"], n["col"], _lit("magic-number"), F.concat(_lit("magic number "), name(n)), _lit("hint"), _lit("Extract into a named constant.")))


def parameters_rule(found: Column) -> Column:
    """Functions, arrows and methods with more than WARNING_PARAMETERS parameters, at the function, the arrow's parenthesis or the method's name."""
    long = F.filter(found, lambda n: (n["type"] == "formal_parameters") & (n["kids"] > WARNING_PARAMETERS))
    paired = F.transform(long, lambda p: F.struct(p.alias("p"), F.get(F.filter(found, lambda n: (n["pre"] == p["parent"]) & n["type"].isin(*_FUNCTIONS)), _lit(0)).alias("f")))

    def one(x: Column) -> Column:
        p, f = x["p"], x["f"]
        place = lambda own: F.when(f["type"] == "arrow_function", p[own]).when(f["type"] == "method_definition", f[f"name_{own}"]).otherwise(f[own])
        message = F.concat(F.coalesce(f["name"], _lit("anonymous")), _lit(" has "), p["kids"].cast("string"), _lit(" parameters"))
        return _match(place("line"), place("col"), _lit("long-params"), message, F.when(p["kids"] > ERROR_PARAMETERS, "error").otherwise("warning"), _lit("Use an options object or destructuring to reduce parameter count."))

    return F.transform(F.filter(paired, lambda x: x["f"].isNotNull()), one)


RULES: dict[str, Callable[[Column], Column]] = {"imports": imports_rule, "nesting": nesting_rule, "danger": danger_rule, "numbers": numbers_rule, "parameters": parameters_rule}


def parsed(files: DataFrame, *rules: str) -> DataFrame:
    """``files`` with ``_tree``: the nodes that some rules (all, if none is named) look at, or the error of a source that can't be parsed."""
    kinds = tuple(sorted({k for r in rules or RULES for k in _KINDS[r]}))
    return files.withColumn("_tree", tree(F.col("content"), kinds))


def _matches(files: DataFrame, prefix: str, *rules: str) -> DataFrame:
    own = rules or tuple(RULES)
    found = F.concat(*[RULES[r](F.col("_nodes")) for r in own])
    m = parsed(files.select("file_path", "content"), *own).select("file_path", "content", F.col("_tree.nodes").alias("_nodes"))
    lined = m.select("file_path", F.split("content", "\n").alias("_lines"), F.explode(found).alias("m"))
    out = lined.select("file_path", "m.*", F.regexp_replace(F.get("_lines", F.col("m.line") - 1), r"^\s+|\s+$", "").alias("snippet"))
    return out.withColumn("rule", F.concat(_lit(f"{prefix}/"), F.col("rule"))).select(*_COLUMNS)


def dangerous_calls(files: DataFrame, prefix: str = "sievecast") -> DataFrame:
    return _matches(files, prefix, "danger")


def magic_numbers(files: DataFrame, prefix: str = "sievecast") -> DataFrame:
    return _matches(files, prefix, "numbers")


def deep_blocks(files: DataFrame, prefix: str = "sievecast") -> DataFrame:
    return _matches(files, prefix, "nesting")


def unused_imports(files: DataFrame, prefix: str = "sievecast") -> DataFrame:
    return _matches(files, prefix, "imports")


def long_parameter_lists(files: DataFrame, prefix: str = "sievecast") -> DataFrame:
    return _matches(files, prefix, "parameters")


def all_rules(files: DataFrame, prefix: str = "sievecast") -> DataFrame:
    """The matches of all rules: one parse a file. A source that can't be parsed has none here, and a row in :func:`failures`."""
    return _matches(files, prefix)


def failures(files: DataFrame) -> DataFrame:
    """``file_path, error`` of the sources that no rule can look at."""
    return parsed(files.select("file_path", "content"), "numbers").select("file_path", F.col("_tree.error").alias("error")).filter("error IS NOT NULL")


def node_table(files: DataFrame, kinds: tuple[str, ...] | None = None, shapes: tuple | None = None) -> DataFrame:
    """A row for each node of each file's tree (of some types, if given): ``file_path, pre, last, depth, parent, type, field, line, col, name, name_line, name_col, under, nesting, kids, snippet``.

    A node's subtree is the numbers pre to last, so what stands in it is told by intervals; its children have
    it as parent. The snippet is its line, trimmed. Null contents have no nodes; an empty one has its program.
    ``shapes`` are patterns as :func:`syntax_tree.tree` takes them.
    """
    t = files.select("file_path", F.split("content", "\n").alias("_lines"), tree(F.col("content"), kinds, shapes)["nodes"].alias("_nodes"))
    rows = t.select("file_path", "_lines", F.explode("_nodes").alias("n"))
    return rows.select("file_path", "n.*", F.regexp_replace(F.get("_lines", F.col("n.line") - 1), r"^\s+|\s+$", "").alias("snippet"))


class SyntaxNodes:
    """The nodes of a text as a table function: ``SELECT * FROM files, LATERAL syntax_nodes(content)``."""

    def eval(self, source: str) -> Iterator[tuple]:
        if source is not None:
            yield from map(tuple, nodes(source))


def register(spark: SparkSession, name: str = "syntax_nodes") -> None:
    """Make the table function known to a session's SQL."""
    spark.udtf.register(name, F.udtf(SyntaxNodes, returnType=NODE[len("struct<") : -1].replace(":", " ")))


def contained(rows: DataFrame, outer: str) -> DataFrame:
    """The rows of a node table that stand in a node of type ``outer``, at any depth: of a file's nodes in order, the furthest end of those of that type before a node reaches it. A window, no join of intervals."""
    from pyspark.sql import Window

    before = Window.partitionBy("file_path").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_end", F.max(F.when(F.col("type") == outer, F.col("last"))).over(before)).filter(F.col("_end") >= F.col("pre")).drop("_end")
