"""Suppression directives in comments, and the matches they silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_suppressions(files: DataFrame, prefix: str = "sievecast") -> DataFrame:
    """``file_path, scope, line, rule`` of ``// <prefix>-disable-line|next-line|file [rules]`` (or ``#``).

    What follows the directive on its line names rules, by blanks or commas; none means ``*``. A directive
    may start on the line after its ``//``, so whole texts are searched, not lines.
    """
    names = rf"{prefix}-disable-(line|next-line|file)\b([^\n]*)"
    token = rf"(?i)(?://|#)\s*{names}|\n"
    tokens = F.regexp_extract_all("content", F.lit(token), F.lit(0))
    newlines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line:int,text:string>>").alias("found"))
    walked = F.aggregate(F.filter(tokens, lambda t: t.isNotNull()), start, lambda s, t: F.struct((s["line"] + newlines(t)).alias("line"), F.when(t == "\n", s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(s["line"].alias("line"), t.alias("text"))))).alias("found")))
    found = files.filter(F.lower("content").contains(f"{prefix}-disable-")).select("file_path", F.inline(walked["found"]))
    scope = F.lower(F.regexp_extract("text", f"(?i){names}", 1))
    rules = F.filter(F.split(F.lower(F.regexp_extract("text", f"(?i){names}", 2)), r"[\s,]+"), lambda r: r != "")
    rules = F.when(F.size(rules) == 0, F.array(F.lit("*"))).otherwise(F.transform(rules, short_rule))
    line = F.when(scope == "file", 0).when(scope == "next-line", F.col("line") + 1).otherwise(F.col("line"))
    return found.select("file_path", F.when(scope == "file", "file").otherwise("line").alias("scope"), line.alias("line"), F.explode(rules).alias("rule")).distinct()


def short_rule(rule: Column) -> Column:
    """The last segment of a rule's name, in lower case."""
    return F.lower(F.substring_index(rule, "/", -1))


def unsuppressed(matches: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Matches that no directive of their file silences; those for a whole file (line 0) only by file directives. An equi-join on the file."""
    s = suppressions.select(F.col("file_path").alias("_f"), F.col("scope").alias("_scope"), F.col("line").alias("_line"), F.col("rule").alias("_rule"))
    on = (F.col("file_path") == F.col("_f")) & ((F.col("_scope") == "file") | ((F.col("_line") == F.col("line")) & (F.col("line") != 0))) & ((F.col("_rule") == "*") | (F.col("_rule") == short_rule(F.col("rule"))))
    return matches.join(s, on, "left_anti")
