"""Rule matches of files: pattern hits joined with rule specs, and thresholds of metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, patterns

PREFIX = "sievecast"
#: Pattern, rule, message, severity, fix.
RULE_SPECS = (
    ("eval", "eval-detected", "Avoid eval()", "error", "use a safer parser (JSON.parse, Function constructor with explicit args) or drop the dynamic path."),
    ("debugger", "debugger-statement", "Debugger statement", "warning", "delete this line."),
    ("console-log", "console-log", "console.* in production", "info", "remove or guard with a debug flag (e.g. `if (DEBUG) console.log(...)`)."),
    ("empty-catch", "error-swallowing", "Empty catch block", "warning", "log the error, rethrow, or add a comment explaining the intentional swallow."),
    ("hardcoded-secret", "hardcoded-secret", "Hardcoded credential", "error", "move to an env var; never commit secrets to source."),
    ("alert", "no-alert", "alert() in production", "warning", "use a proper UI affordance (toast, modal) instead of alert()."),
)


@dataclass(frozen=True)
class Thresholds:
    """A metric above these gives a warning or an error."""

    cyclomatic_warning: int = 15
    cyclomatic_error: int = 40
    cognitive_warning: int = 25
    cognitive_error: int = 50


def _measured(viewed: DataFrame) -> DataFrame:
    """Files of :func:`patterns.views` with cyclomatic, cognitive, max_nesting, lines_of_code, from the masks that are there. Metrics look at ASCII alone, so byte views do."""
    m = viewed.withColumn("_tokens", metrics.code_tokens(F.col("_plain"))).withColumn("_fold", metrics.nesting_and_cognitive(F.col("_tokens")))
    m = m.withColumns({"cyclomatic": metrics.cyclomatic(F.col("_tokens")), "cognitive": F.col("_fold.cost"), "max_nesting": F.col("_fold.most"), "lines_of_code": metrics.lines_of_code(F.col("_quoted"))})
    return m.drop("_tokens", "_fold")


def file_metrics(files: DataFrame) -> DataFrame:
    """``files`` (file_path, content) with cyclomatic, cognitive, max_nesting, lines_of_code, entropy. One mask of each kind a file serves all."""
    return _measured(patterns.views(files)).drop("_text", "_plain", "_quoted").withColumn("entropy", metrics.byte_entropy("content"))


def rule_specs(spark, prefix: str = PREFIX) -> DataFrame:
    return spark.createDataFrame([(p, f"{prefix}/{r}", m, s, f) for p, r, m, s, f in RULE_SPECS], "pattern string, rule string, message string, severity string, fix string")


def pattern_hits(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """``file_path, line, col, pattern, snippet``: a row a hit."""
    found = patterns.detect(F.col("_plain"), F.col("_quoted"), F.col("_text"), pattern)
    return patterns.views(files.select("file_path", "content")).select("file_path", F.inline(found))


_MATCH = ("id", "file_path", "line", "col", "rule", "message", "severity", "snippet", "fix")


def pattern_matches(hits: DataFrame, specs: DataFrame) -> DataFrame:
    """Hits with their rule. Patterns without a spec are dropped. Spark broadcasts the specs as long as they are few."""
    return hits.join(specs, "pattern").withColumn("id", F.concat_ws(":", "rule", "file_path", "line", "col")).select(*_MATCH)


def _issue(metric: str, rule: str, warning: int, error: int, prefix: str) -> Column:
    value = F.col(metric)
    severity = F.when(value > error, "error").when(value > warning, "warning")
    made = F.struct(F.lit(f"{prefix}/{rule}").alias("rule"), F.concat(F.lit(f"{metric} complexity is "), value).alias("message"), severity.alias("severity"))
    return F.when(severity.isNotNull(), made)


def _issues(t: Thresholds, prefix: str) -> Column:
    return F.array_compact(F.array(_issue("cyclomatic", "high-complexity", t.cyclomatic_warning, t.cyclomatic_error, prefix), _issue("cognitive", "high-cognitive-complexity", t.cognitive_warning, t.cognitive_error, prefix)))


def threshold_matches(measured: DataFrame, t: Thresholds = Thresholds(), prefix: str = PREFIX) -> DataFrame:
    """Matches for whole files (line 0) whose metrics are above a threshold."""
    m = measured.select("file_path", F.inline(_issues(t, prefix)))
    return m.select(F.concat_ws(":", "rule", "file_path").alias("id"), "file_path", F.lit(0).alias("line"), F.lit(0).alias("col"), "rule", "message", "severity", F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("fix"))


def match_arrays(files: DataFrame, thresholds: Thresholds = Thresholds(), prefix: str = PREFIX) -> DataFrame:
    """``files`` with ``matches``: an array of all built-in matches of the file. One scan and one mask of each kind, no join and no shuffle; a null content has none."""
    found = patterns.detect(F.col("_plain"), F.col("_quoted"), F.col("_text"))
    specs = F.create_map(*[x for p, r, m, s, f in RULE_SPECS for x in (F.lit(p), F.struct(F.lit(f"{prefix}/{r}").alias("rule"), F.lit(m).alias("message"), F.lit(s).alias("severity"), F.lit(f).alias("fix")))])
    none = F.lit(None).cast("string")

    def of_hit(h: Column) -> Column:
        spec = F.element_at(specs, h["pattern"])
        return F.struct(F.concat_ws(":", spec["rule"], "file_path", h["line"], h["col"]).alias("id"), h["line"].alias("line"), h["col"].alias("col"), spec["rule"].alias("rule"), spec["message"].alias("message"), spec["severity"].alias("severity"), h["snippet"].alias("snippet"), spec["fix"].alias("fix"))

    def of_issue(i: Column) -> Column:
        return F.struct(F.concat_ws(":", i["rule"], "file_path").alias("id"), F.lit(0).alias("line"), F.lit(0).alias("col"), i["rule"].alias("rule"), i["message"].alias("message"), i["severity"].alias("severity"), none.alias("snippet"), none.alias("fix"))

    m = _measured(patterns.views(files.select("file_path", "content"))).withColumns({"_hits": found, "_issues": _issues(thresholds, prefix)})
    return m.select("file_path", "content", F.coalesce(F.concat(F.transform("_hits", of_hit), F.transform("_issues", of_issue)), F.array()).alias("matches"))


def all_matches(files: DataFrame, thresholds: Thresholds = Thresholds(), prefix: str = PREFIX) -> DataFrame:
    """A row for each built-in match of the files."""
    return match_arrays(files, thresholds, prefix).select("file_path", F.inline("matches")).select(*_MATCH)


def crossing_facts(versions: DataFrame, nesting: int = 6, nesting_error: int = 10, entropy: float = 6.5, absolute: bool = False, prefix: str = PREFIX) -> DataFrame:
    """Facts of rows (file_path, nesting_before, nesting_after, entropy_before, entropy_after): a metric that an edit took above its bound, or that just is above."""
    crossed = lambda after, before, t: (F.col(after) > t) if absolute else (F.col(after) > t) & (F.coalesce(F.col(before), F.lit(0)) <= t)
    deep = F.when(crossed("nesting_after", "nesting_before", nesting), F.struct(F.lit(f"{prefix}/deep-nesting").alias("rule"), F.when(F.col("nesting_after") > nesting_error, "error").otherwise("warning").alias("severity")))
    dense = F.when(crossed("entropy_after", "entropy_before", entropy), F.struct(F.lit(f"{prefix}/high-entropy").alias("rule"), F.lit("info").alias("severity")))
    return versions.select("file_path", F.inline(F.array_compact(F.array(deep, dense))))
