"""Tool output -> diagnostics. Input: ``file_path, tool, format, stdout``; bad output gives no rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of messages about a tool's own configuration.
CONFIG_NOISE = ("file ignored", "no matching configuration", "no eslint configuration")
#: Phrases of lines that are no diagnostics.
TEXT_NOISE = ("File ignored", "No files matching")
COLUMNS = ("file_path", "tool", "line", "col", "severity", "rule", "message", "has_fix")


def map_severity(c: Column) -> Column:
    s = F.lower(c)
    return F.when(s.isNull(), "warning").when(s.isin("error", "fatal"), "error").when(s.isin("warning", "warn"), "warning").when(s == "hint", "hint").otherwise("info")


def _rows(df: DataFrame, line, col, severity, rule, message, has_fix=None) -> DataFrame:
    return df.select("file_path", "tool", F.coalesce(line, F.lit(0)).cast("int").alias("line"), F.coalesce(col, F.lit(0)).cast("int").alias("col"), severity.alias("severity"), rule.alias("rule"), message.alias("message"), (F.lit(False) if has_fix is None else has_fix).alias("has_fix"))


def _items(output: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    parsed = F.from_json("stdout", schema)
    return output.select("file_path", "tool", F.explode(parsed if path is None else parsed[path]).alias("d"))


def eslint(output: DataFrame) -> DataFrame:
    """Files with messages. Severity 2 is an error, else a warning; notes about configuration go."""
    m = _items(output, "array<struct<messages:array<struct<ruleId:string,message:string,severity:int,line:int,column:int,fix:string>>>>")
    m = m.select("file_path", "tool", F.explode("d.messages").alias("d"))
    noise = (F.col("d.line").eqNullSafe(0) & (F.coalesce("d.ruleId", F.lit("")) == "")) | reduce(Column.__or__, [F.lower("d.message").contains(x) for x in CONFIG_NOISE])
    m = m.filter(~F.coalesce(noise, F.lit(False)))
    return _rows(m, F.col("d.line"), F.col("d.column"), F.when(F.col("d.severity") == 2, "error").otherwise("warning"), F.coalesce("d.ruleId", F.lit("eslint")), F.coalesce("d.message", F.lit("")), F.col("d.fix").isNotNull())


def generic_json(output: DataFrame) -> DataFrame:
    """An array of diagnostics, or an object with one under diagnostics, messages or issues: the first that is not null."""
    item = "array<struct<line:int,column:int,severity:string,rule:string,message:string>>"
    whole = F.from_json("stdout", f"struct<diagnostics:{item},messages:{item},issues:{item}>")
    found = F.when(F.ltrim("stdout").startswith("["), F.from_json("stdout", item)).otherwise(F.coalesce(whole["diagnostics"], whole["messages"], whole["issues"]))
    m = output.select("file_path", "tool", F.explode(found).alias("d"))
    return _rows(m, F.col("d.line"), F.col("d.column"), map_severity(F.col("d.severity")), F.coalesce("d.rule", "tool"), F.coalesce("d.message", F.lit("")))


def _lines(output: DataFrame, regex: str, *groups: str) -> DataFrame:
    m = output.select("file_path", "tool", F.posexplode(F.split("stdout", "\n")).alias("row", "text")).filter(F.col("text").rlike(regex))
    return m.select("file_path", "tool", "row", "text", *[F.regexp_extract("text", regex, k + 1).alias(g) for k, g in enumerate(groups)])


def generic_text(output: DataFrame) -> DataFrame:
    """Lines like ``12:3 error message``, anywhere in the line and in any case."""
    m = _lines(output, r"(?i)(\d+):(\d+)\s+(error|warning|info|hint)\s+(.*)", "l", "c", "s", "m")
    m = m.filter(~reduce(Column.__or__, [F.col("text").contains(x) for x in TEXT_NOISE]))
    return _rows(m, F.col("l").try_cast("int"), F.col("c").try_cast("int"), map_severity(F.col("s")), F.col("tool"), F.trim("m"))


def tsc(output: DataFrame) -> DataFrame:
    """Lines like ``file:1:2 - error TS2322: message``."""
    m = _lines(output, r"(?:(.+?):)?(\d+):(\d+)\s*-\s*(error|warning)\s*(?:TS\d+:\s*)?(.*)", "f", "l", "c", "s", "m")
    return _rows(m, F.col("l").try_cast("int"), F.col("c").try_cast("int"), F.col("s"), F.concat(F.lit("tsc/"), F.col("s")), F.trim("m"))


def mypy(output: DataFrame) -> DataFrame:
    m = _items(output, "array<struct<severity:string,code:string,line:int,column:int,message:string>>").filter(F.coalesce("d.message", F.lit("")) != "")
    s = F.lower("d.severity")
    return _rows(m, F.col("d.line"), F.col("d.column"), F.when(s == "note", "info").when(s == "warning", "warning").otherwise("error"), F.coalesce("d.code", F.lit("mypy")), F.col("d.message"))


def cargo(output: DataFrame) -> DataFrame:
    """One JSON object a line; the first span places it; spans of other files go, by base name."""
    span = "struct<file_name:string,line_start:int,column_start:int>"
    text = output.select("file_path", "tool", F.explode(F.split("stdout", "\n")).alias("text"))
    m = text.select("file_path", "tool", F.from_json("text", f"struct<message:string,level:string,spans:array<{span}>,code:struct<code:string>>").alias("d"))
    m = m.withColumn("s", F.get("d.spans", F.lit(0))).filter(F.col("d.message").isNotNull())
    m = m.filter(F.col("s").isNull() | F.col("s.file_name").contains(F.substring_index("file_path", "/", -1)))
    level = F.lower("d.level")
    return _rows(m, F.col("s.line_start"), F.col("s.column_start"), F.when(level == "error", "error").when(level.isin("note", "help"), "info").otherwise("warning"), F.concat(F.lit("rustc/"), F.coalesce("d.code.code", F.lit("unknown"))), F.trim("d.message"))


def pyright(output: DataFrame) -> DataFrame:
    """Lines and characters stay as they come, from 0."""
    place = "struct<start:struct<line:int,character:int>>"
    m = _items(output, f"struct<generalDiagnostics:array<struct<message:string,rule:string,severity:string,range:{place}>>>", "generalDiagnostics")
    s = F.lower("d.severity")
    return _rows(m, F.col("d.range.start.line"), F.col("d.range.start.character"), F.when(s == "information", "info").when(s == "message", "hint").when(s == "warning", "warning").otherwise("error"), F.coalesce("d.rule", F.lit("pyright")), F.coalesce("d.message", F.lit("")))


def semgrep(output: DataFrame) -> DataFrame:
    """Also ``reported_path``, which :func:`match_paths` maps to an input file."""
    m = _items(output, "struct<results:array<struct<check_id:string,message:string,severity:string,path:string,start:struct<line:int,col:int>,extra:struct<message:string,severity:string>>>>", "results")
    s = F.upper(F.coalesce("d.extra.severity", "d.severity"))
    severity = F.when(s == "ERROR", "error").when(s == "INFO", "info").otherwise("warning")
    rows = _rows(m.withColumn("_p", F.col("d.path")), F.col("d.start.line"), F.col("d.start.col"), severity, F.coalesce("d.check_id", F.lit("semgrep")), F.coalesce("d.extra.message", "d.message", F.lit("")))
    return rows


def semgrep_findings(output: DataFrame) -> DataFrame:
    """Findings over a directory: by the path that the tool reports."""
    paths = output.select(F.explode(F.from_json("stdout", "struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>>>>")["results"]).alias("d"))
    return paths.select(F.col("d.path").alias("reported_path"), F.col("d.check_id").alias("rule"), F.col("d.start.line").alias("line"), F.col("d.start.col").alias("col"))


def match_paths(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``file_path``: the input of that path, else the first input (by path) of that base name, else as reported."""
    exact = files.select(F.col("file_path").alias("_exact")).distinct()
    by_name = files.groupBy(F.substring_index("file_path", "/", -1).alias("_name")).agg(F.min("file_path").alias("_first"))
    m = findings.join(exact, F.col("reported_path") == F.col("_exact"), "left")
    m = m.join(by_name, F.substring_index("reported_path", "/", -1) == F.col("_name"), "left")
    return m.withColumn("file_path", F.coalesce("_exact", "_first", "reported_path")).drop("_exact", "_first", "_name")


#: Format -> parser; add an entry to add a tool.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"eslint": eslint, "json": generic_json, "generic": generic_text, "tsc": tsc, "mypy-json": mypy, "cargo-json": cargo, "pyright-json": pyright, "semgrep": semgrep}


def parse(output: DataFrame) -> DataFrame:
    """All formats of a table of outputs, each by its parser, as one table."""
    return reduce(DataFrame.unionByName, [parser(output.filter(F.col("format") == name)) for name, parser in PARSERS.items()])
