"""Queries over syntax trees: S-expression patterns become joins of the node table with itself, captures become rows."""

from __future__ import annotations

import contextlib
import dataclasses
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import syntax

_TOKEN = re.compile(r"""\s+|;[^\n]*|(?P<token>"(?:[^"\\]|\\.)*"|[()\[\]]|[A-Za-z_][\w-]*:|![A-Za-z_]\w*|@[\w.-]+|\#[\w-]+\?|[A-Za-z_][\w-]*|[?*+.])""")


@dataclass
class Pattern:
    """A node of a pattern: its types (None: any), the field that it is of its parent, its captures and children, fields that it must not have, and whether it may be missing."""

    types: tuple[str, ...] | None
    field: str | None = None
    captures: list[str] = dataclasses.field(default_factory=list)
    children: list[Pattern] = dataclasses.field(default_factory=list)
    without: list[str] = dataclasses.field(default_factory=list)
    optional: bool = False


@dataclass(frozen=True)
class Predicate:
    kind: str
    capture: str
    values: tuple[str, ...]
    other: str | None = None


@dataclass
class Compiled:
    patterns: list[tuple[Pattern, list[Predicate]]]


_PREDICATES = ("eq", "not-eq", "match", "not-match", "any-of", "not-any-of")


class QueryError(ValueError):
    """A query that can't be read."""


def compile_query(text: str) -> Compiled:
    """Read a query: ``(type field: (type) @capture (#eq? @capture "x"))``.

    Nodes with children, fields, ``!field``, the wildcard ``_``, alternations ``[(a) (b)]`` of nodes
    without children, captures, ``?`` on a node, and the predicates eq, not-eq, match, not-match, any-of and
    not-any-of, whose values are compared with the text of names, numbers and strings. What else the
    language has (anchors, repetitions, anonymous nodes) is an error.
    """
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"no query: {text[at : at + 20]!r}")
        at = m.end()
        if m["token"]:
            tokens.append(m["token"])
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take(wanted: str | None = None) -> str:
        nonlocal place
        t = peek()
        if not t or (wanted and t != wanted):
            raise QueryError(f"{wanted or 'more'} expected, not {t or 'the end'!r}")
        place += 1
        return t

    def suffixes(p: Pattern) -> Pattern:
        while peek()[:1] in ("@", "?") and peek():
            t = take()
            if t == "?":
                p.optional = True
            else:
                p.captures.append(t[1:])
        if peek() in ("*", "+", "."):
            raise QueryError(f"{peek()} is not supported")
        return p

    def node(predicates: list[Predicate]) -> Pattern:
        if peek() == "[":
            take()
            types: list[str] = []
            while peek() != "]":
                one = node(predicates)
                if one.children or one.captures or one.types is None or one.without:
                    raise QueryError("an alternation has plain nodes")
                types += one.types
            take("]")
            if not types:
                raise QueryError("an empty alternation")
            return suffixes(Pattern(tuple(types)))
        if peek() == "_":
            take()
            return suffixes(Pattern(None))
        take("(")
        name = take()
        if not re.fullmatch(r"[A-Za-z_][\w-]*", name):
            raise QueryError(f"a node type expected, not {name!r}")
        p = Pattern(None if name == "_" else (name,))
        while peek() != ")":
            t = peek()
            if t == "(" and place + 1 < len(tokens) and tokens[place + 1].startswith("#"):
                predicates.append(predicate())
            elif t.startswith("!"):
                p.without.append(take()[1:])
            elif t.endswith(":") and t[:-1]:
                own = take()[:-1]
                child = node(predicates)
                child.field = own
                p.children.append(child)
            else:
                p.children.append(node(predicates))
        take(")")
        return suffixes(p)

    def predicate() -> Predicate:
        take("(")
        kind, rest = take()[1:-1], []
        while peek() != ")":
            rest.append(take())
        take(")")
        if kind not in _PREDICATES or len(rest) < 2 or not rest[0].startswith("@"):
            raise QueryError(f"no predicate: {kind} {rest}")
        if rest[1].startswith("@") and kind in ("eq", "not-eq") and len(rest) == 2:
            return Predicate(kind, rest[0][1:], (), rest[1][1:])
        if any(not r.startswith('"') for r in rest[1:]) or (len(rest) > 2 and not kind.endswith("any-of")):
            raise QueryError(f"no values: {rest[1:]}")
        return Predicate(kind, rest[0][1:], tuple(re.sub(r"\\(.)", r"\1", r[1:-1]) if "match" not in kind else r[1:-1].replace('\\"', '"') for r in rest[1:]))

    out: list[tuple[Pattern, list[Predicate]]] = []
    while place < len(tokens):
        if peek() == "(" and place + 1 < len(tokens) and tokens[place + 1].startswith("#"):
            if not out:
                raise QueryError("a predicate without a pattern")
            out[-1][1].append(predicate())
            continue
        predicates: list[Predicate] = []
        out.append((node(predicates), predicates))
    if not out:
        raise QueryError("an empty query")
    for p, predicates in out:
        known = _captures(p)
        for x in predicates:
            if x.capture not in known or (x.other and x.other not in known):
                raise QueryError(f"no capture @{x.capture}")
    return Compiled(out)


def _captures(p: Pattern) -> set[str]:
    return set(p.captures).union(*map(_captures, p.children))


def _shape(p: Pattern) -> tuple:
    return p.types, p.field, p.optional, tuple(p.without), tuple(map(_shape, p.children))


def _types(p: Pattern) -> set[str | None]:
    """The types that a pattern reads; None, if it reads any."""
    return {*(p.types or (None,)), *([None] if p.without else [])}.union(*map(_types, p.children))


def node_table(files: DataFrame, *queries: str) -> DataFrame:
    """The nodes that can be part of a match of some queries: over it, they find what they find over all nodes. It has as many rows as the matches have, not as the sources, so it can be cached, to parse once. Queries that can't be read have none."""
    patterns = []
    for q in queries:
        with contextlib.suppress(QueryError):
            patterns += [p for p, _ in compile_query(q).patterns]
    types = set().union(*map(_types, patterns))
    return syntax.node_table(files, None if None in types else tuple(sorted(types)), tuple(map(_shape, patterns)))


_KEPT = ("pre", "last", "type", "line", "col", "name", "snippet")


def _of(nodes: DataFrame, p: Pattern) -> DataFrame:
    out = nodes if p.types is None else nodes.filter(F.col("type").isin(*p.types))
    for name in p.without:
        has = nodes.filter(F.col("field") == name).select(F.col("file_path"), F.col("parent").alias("pre")).distinct().hint("merge")
        out = out.join(has, ["file_path", "pre"], "left_anti")
    return out


def _pattern_matches(nodes: DataFrame, root: Pattern, predicates: list[Predicate]) -> DataFrame:
    """One row a match: ``file_path`` and, of each pattern node k, the kept columns as a struct ``_k``."""
    captured: dict[str, list[int]] = {}
    counter = 0

    def add(joined: DataFrame | None, p: Pattern, parent: int | None, earlier: list[int]) -> DataFrame:
        nonlocal counter
        k = counter
        counter += 1
        for c in p.captures:
            captured.setdefault(c, []).append(k)
        own = _of(nodes, p).select("file_path", F.col("parent").alias(f"_up{k}"), F.col("field").alias(f"_field{k}"), F.struct(*_KEPT).alias(f"_{k}"))
        if joined is None:
            out = own.drop(f"_up{k}", f"_field{k}")
        else:
            if p.field is not None:
                own = own.filter(F.col(f"_field{k}") == p.field)
            own = own.drop(f"_field{k}").withColumnRenamed("file_path", "_file").hint("merge")  # by the sources' rows Spark would take nodes for few, and broadcast them
            on = [joined["file_path"] == own["_file"], joined[f"_{parent}"]["pre"] == own[f"_up{k}"]]
            on += [joined[f"_{e}"].isNull() | (joined[f"_{e}"]["pre"] < own[f"_{k}"]["pre"]) for e in earlier]
            out = joined.join(own, reduce(Column.__and__, on), "left" if p.optional else "inner").drop("_file", f"_up{k}")
        before: list[int] = []
        for child in p.children:
            here = counter
            out = add(out, child, k, before)
            before = [here] if not child.optional else [*before, here]
        return out

    out = add(None, root, None, [])
    text = lambda c: [F.col(f"_{k}")["name"] for k in captured[c]]
    for x in predicates:
        for own in text(x.capture):
            if x.other is not None:
                equal = reduce(Column.__and__, [own.eqNullSafe(o) for o in text(x.other)])
                test = equal if x.kind == "eq" else ~equal
            elif x.kind in ("eq", "any-of"):
                test = own.isin(*x.values)
            elif x.kind in ("not-eq", "not-any-of"):
                test = ~F.coalesce(own.isin(*x.values), F.lit(False))
            else:
                hit = F.coalesce(own.rlike(x.values[0]), F.lit(False))
                test = hit if x.kind == "match" else ~hit
            out = out.filter(F.coalesce(test, F.lit(False)))
    rows = F.array(*[F.struct(F.lit(c).alias("capture"), *[F.col(f"_{k}")[x].alias(x) for x in _KEPT]) for c, ks in captured.items() for k in ks])
    shaped = "array<struct<capture:string,pre:int,last:int,type:string,line:int,col:int,name:string,snippet:string>>"
    return out.select("file_path", F.col("_0")["pre"].alias("match"), F.explode(F.filter((rows if captured else F.array()).cast(shaped), lambda r: r["pre"].isNotNull())).alias("r")).select("file_path", "match", "r.*")


def run_query(nodes: DataFrame, query: str | Compiled) -> DataFrame:
    """``file_path, pattern, match, capture, line, col, type, name, snippet``: a row for each capture of each match of a query over a node table.

    ``nodes`` is what :func:`node_table` or :func:`syntax.node_table` gives, best cached or stored: each node of a pattern reads it, and is
    joined to its parent on file and number, so every join has equal keys; children of one node stand in the
    order of the pattern. ``match`` is the number of the node that the pattern began at. Snippet and
    text are as in the node table. A file without a match has no row; a query that can't be read is a QueryError.
    """
    compiled = compile_query(query) if isinstance(query, str) else query
    found = [_pattern_matches(nodes, p, predicates).withColumn("pattern", F.lit(k)) for k, (p, predicates) in enumerate(compiled.patterns)]
    return reduce(DataFrame.unionByName, found).select("file_path", "pattern", "match", "capture", "line", "col", "type", "name", "snippet")


@dataclass(frozen=True)
class AstRule:
    """A query whose captures are issues."""

    id: str
    query: str
    message: str
    severity: str
    rule: str
    fix: str | None = None
    language: str = "typescript"


def run_rules(nodes: DataFrame, rules: list[AstRule]) -> tuple[DataFrame, DataFrame]:
    """Matches of all rules (id, rule, message, severity, file_path, line, col, snippet, fix), and the rules that could not be run (id, error).

    Rules of other languages than typescript are left out. A rule that can't be read takes nothing from the others.
    """
    spark = nodes.sparkSession
    found, errors = [], []
    for r in rules:
        if r.language != "typescript":
            continue
        try:
            m = run_query(nodes, r.query)
        except QueryError as e:
            errors.append((r.id, str(e)))
            continue
        place = F.concat_ws(":", F.lit(r.rule), "file_path", F.col("line").cast("string"), F.col("col").cast("string"))
        found.append(m.select(place.alias("id"), F.lit(r.rule).alias("rule"), F.lit(r.message).alias("message"), F.lit(r.severity).alias("severity"), "file_path", "line", "col", "snippet", F.lit(r.fix).cast("string").alias("fix")))
    none = spark.createDataFrame([], "id string, rule string, message string, severity string, file_path string, line int, col int, snippet string, fix string")
    return reduce(DataFrame.unionByName, found, none), spark.createDataFrame(errors, "id string, error string")
