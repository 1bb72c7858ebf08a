"""Extension points: own patterns, thresholds and parsers beside the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from re import _parser as _regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import hits, views
from . import parsers, rules


_HITS = "array<struct<line:int,col:int,pattern:string,snippet:string>>"


def required_literal(regex: str) -> str:
    """The longest run of ASCII letters and signs that every match of a regular expression has in it, or nothing where none is sure."""
    try:
        tree = _regex.parse(regex)
    except (_regex.error, RecursionError, OverflowError):  # what only Spark's dialect knows
        return ""
    if tree.state.flags & _regex.SRE_FLAG_IGNORECASE:
        return ""
    runs = [""]

    def look(parts) -> None:
        for op, value in parts:
            if op is _regex.LITERAL and value < 128:
                runs[-1] += chr(value)
            elif op is _regex.SUBPATTERN and not value[1]:
                look(value[3])
            elif op is not _regex.AT:
                runs.append("")

    look(tree)
    return max(runs, key=len)


@dataclass
class Registry:
    """Collects rules and makes one table of matches of them and the built-in ones."""

    prefix: str = rules.PREFIX
    patterns: list[tuple[str, str, str, str, str | None]] = field(default_factory=list)
    metrics: list[tuple[str, Callable[[Column], Column], float, str, str]] = field(default_factory=list)

    def add_pattern(self, name: str, regex: str, message: str, severity: str = "warning", fix: str | None = None) -> Registry:
        """A regular expression over texts whose comments and literals are blanked."""
        self.patterns.append((name, regex, message, severity, fix))
        return self

    def add_threshold(self, name: str, metric: Callable[[Column], Column], above: float, message: str, severity: str = "warning") -> Registry:
        """A column function of the content and the value above which it is an issue of the whole file."""
        self.metrics.append((name, metric, above, message, severity))
        return self

    @staticmethod
    def add_parser(name: str, parser: Callable[[DataFrame], DataFrame]) -> None:
        parsers.PARSERS[name] = parser

    def pattern_matches(self, files: DataFrame) -> DataFrame:
        """Matches of the registered patterns: one scan and one mask of the files, however many patterns there are.

        Patterns are searched each for itself, so that they may overlap, and a text without the literal that a
        pattern cannot match without is not searched for it.
        """
        none = F.array().cast(_HITS)

        def of(k: int, regex: str) -> Column:
            found, literal = hits(F.col("_plain"), F.col("_text"), regex, str(k)), required_literal(regex)
            return F.when(F.contains(F.col("_plain"), F.lit(literal)), found).otherwise(none) if literal else found

        spec = F.create_map(*[x for k, (name, _, message, severity, fix) in enumerate(self.patterns) for x in (F.lit(str(k)), F.struct(F.lit(f"{self.prefix}/{name}").alias("rule"), F.lit(message).alias("message"), F.lit(severity).alias("severity"), F.lit(fix).cast("string").alias("fix")))]) if self.patterns else F.lit(None).cast("map<string,struct<rule:string,message:string,severity:string,fix:string>>")
        every = F.flatten(F.array(*[of(k, p[1]) for k, p in enumerate(self.patterns)])) if self.patterns else none
        found = views(files.select("file_path", "content")).select("file_path", F.inline(every))
        out = found.withColumn("_spec", F.element_at(spec, F.col("pattern"))).select("file_path", "line", "col", "snippet", "_spec.*")
        return out.select(F.concat_ws(":", "rule", "file_path", "line", "col").alias("id"), "file_path", "line", "col", "rule", "message", "severity", "snippet", "fix")

    def threshold_matches(self, files: DataFrame) -> DataFrame:
        """Files that a registered metric is too high for: one scan for all metrics."""
        none = F.lit(None).cast("string")
        made = [F.when(metric(F.col("content")) > above, F.struct(F.lit(f"{self.prefix}/{name}").alias("rule"), F.lit(message).alias("message"), F.lit(severity).alias("severity"))) for name, metric, above, message, severity in self.metrics]
        found = files.select("file_path", F.inline(F.array_compact(F.array(*made))))
        return found.select(F.concat_ws(":", "rule", "file_path").alias("id"), "file_path", F.lit(0).alias("line"), F.lit(0).alias("col"), "rule", "message", "severity", none.alias("snippet"), none.alias("fix"))

    def matches(self, files: DataFrame, thresholds: rules.Thresholds = rules.Thresholds()) -> DataFrame:
        """The built-in matches and all registered ones."""
        out = rules.all_matches(files, thresholds, self.prefix)
        if self.patterns:
            out = out.unionByName(self.pattern_matches(files))
        return out.unionByName(self.threshold_matches(files)) if self.metrics else out
