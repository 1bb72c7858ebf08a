"""One query an operator, with its SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import mask as masks
from ..functions import metrics, score, text
from ..operators import asof, ast_query, config, diff, incremental, lifecycle, parsers, registry, report, rules, suppress, syntax
from ..storage import shared_folder
from ..streaming import feed, session
from .inputs import CODE_SQL, DIAGNOSTICS_SQL, EDITS_SQL, code, diagnostics, edits, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The mask and what stands on it, in RE2's dialect and lists.
_TOKEN = masks.TOKEN.replace("++", "+").replace("*+", "*").replace("'", "''")
_KEEP = lambda c: f"regexp_replace({c}, '[^\\n]', chr(2), 'g')"
_CLOSED = "len(t) > 1 AND regexp_full_match(t, '(?s)(?:''(?:[^\\\\]|\\\\.)*?''|\"(?:[^\\\\]|\\\\.)*?\"|`(?:[^\\\\]|\\\\.)*?`)')"
_LISTED = f"""listed AS (SELECT file_path, content, regexp_extract_all(content, '{_TOKEN}') AS tokens FROM code)"""
_MASKED = f"""{CODE_SQL}, {_LISTED},
masked AS (SELECT file_path, content, array_to_string(list_transform(tokens, lambda t: CASE WHEN t[1:2] IN ('//', '/*') OR t[1] IN ('''', '"', '`') THEN regexp_replace(t, '[^\\n]', chr(1), 'g') ELSE t END), '') AS m,
  array_to_string(list_transform(tokens, lambda t: CASE WHEN t[1:2] IN ('//', '/*') THEN regexp_replace(t, '[^\\n]', chr(1), 'g')
    WHEN t[1] IN ('''', '"', '`') THEN CASE WHEN {_CLOSED} THEN t[1] || {_KEEP('t[2:-2]')} || t[1] ELSE t[1] || {_KEEP('t[2:]')} END ELSE t END), '') AS q FROM listed)"""


@query(f"WITH {_MASKED} SELECT file_path, md5(m) AS masked, md5(q) AS quoted FROM masked")
def mask_text(spark, sf_dir):
    c = F.col("content")
    return code(spark, sf_dir).select("file_path", F.md5(masks.mask(c)).alias("masked"), F.md5(masks.mask_keeping_quotes(c)).alias("quoted"))


_CRLF = "replace(text, '. ', concat('.', chr(13), chr(10)))"


@query(f"SELECT doc_id, md5(regexp_replace({_CRLF}, '\\r\\n?', chr(10), 'g')) AS h FROM documents")
def newline_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_newlines(F.expr(_CRLF))).alias("h"))


_TRAIL = "replace(text, '. ', concat('. ', chr(9), chr(10)))"


@query(f"SELECT doc_id, md5(regexp_replace({_TRAIL}, '(?m)[ \\t]+$', '', 'g')) AS h FROM documents")
def trim_trailing_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.trim_trailing_whitespace(F.expr(_TRAIL))).alias("h"))


@query("SELECT p_partkey, list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(concat(p_name, p_type), ''), lambda x: ascii(x)::HUGEINT)), lambda h, x: (h * 33 + x) % 4294967296)::BIGINT AS h FROM part")
def djb2_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.djb2(F.concat("p_name", "p_type")).alias("h"))


_SUFFIXES = "flatten(list_transform(string_split(content, chr(10))[1:2], lambda x: flatten(list_transform(range(1, len(x) + 1), lambda k: list_transform(string_split(x[k:], ''), lambda t: ascii(t)::HUGEINT)))))"


@query(f"WITH {CODE_SQL} SELECT file_path, list_reduce(list_prepend(5381::HUGEINT, {_SUFFIXES}), lambda h, x: (h * 33 + x) % 4294967296)::BIGINT AS h FROM code")
def range_hash(spark, sf_dir):
    return code(spark, sf_dir).select("file_path", text.hash_lines(F.col("content"), 1, 2).alias("h"))


@query(f"WITH {CODE_SQL} SELECT file_path, CAST(generate_subscripts(s, 1) AS INTEGER) AS line, unnest(s) AS text FROM (SELECT file_path, string_split(content, chr(10)) AS s FROM code)")
def line_explode(spark, sf_dir):
    return code(spark, sf_dir).select("file_path", F.posexplode(F.split("content", "\n")).alias("p", "text")).select("file_path", (F.col("p") + 1).alias("line"), "text")


@query(f"WITH {_MASKED} SELECT file_path, CAST(len(list_filter(string_split(q, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x01\\x02]'))) AS INTEGER) AS loc FROM masked")
def loc(spark, sf_dir):
    return code(spark, sf_dir).select("file_path", metrics.lines_of_code(masks.mask_keeping_quotes(F.col("content"))).alias("loc"))


_CODE_TOKENS = "regexp_extract_all(m, '[A-Za-z0-9_$]+|[{}]|&&|\\|\\||\\?+\\.?')"
_SPLIT = f"""toks AS (SELECT file_path, unnest({_CODE_TOKENS}) AS t, generate_subscripts({_CODE_TOKENS}, 1) AS i FROM masked),
run AS (SELECT *, sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY i) AS s FROM toks WHERE t IN ('{{', '}}', 'if', 'while', 'for', 'case')),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY file_path ORDER BY i)) AS depth FROM run)"""


def _tokens(spark, sf_dir):
    return code(spark, sf_dir).select("file_path", metrics.code_tokens(masks.mask(F.col("content"))).alias("t"))


@query(f"WITH {_MASKED} SELECT file_path, CAST(1 + len(list_filter({_CODE_TOKENS}, lambda t: t IN ('if', 'while', 'for', 'case', '&&', '||', '?'))) AS INTEGER) AS cyclomatic FROM masked")
def cyclomatic(spark, sf_dir):
    return _tokens(spark, sf_dir).select("file_path", metrics.cyclomatic(F.col("t")).alias("cyclomatic"))


@query(f"WITH {_MASKED}, {_SPLIT} SELECT file_path, CAST(sum(CASE WHEN t NOT IN ('{{', '}}') THEN 1 + depth ELSE 0 END) AS INTEGER) AS cognitive FROM deep GROUP BY file_path")
def cognitive(spark, sf_dir):
    return _tokens(spark, sf_dir).select("file_path", metrics.nesting_and_cognitive(F.col("t"))["cost"].alias("cognitive"))


@query(f"WITH {_MASKED}, {_SPLIT} SELECT file_path, CAST(max(depth) AS INTEGER) AS max_nesting FROM deep GROUP BY file_path")
def max_nesting(spark, sf_dir):
    return _tokens(spark, sf_dir).select("file_path", metrics.nesting_and_cognitive(F.col("t"))["most"].alias("max_nesting"))


@query("""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents), n AS (SELECT doc_id, x, count(*) AS c FROM b WHERE x NOT IN ('09', '0A', '0B', '0C', '0D', '20') GROUP BY doc_id, x),
e AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM n GROUP BY doc_id) SELECT d.doc_id, round(coalesce(e, 0), 6) AS entropy FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id""")
def byte_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(metrics.byte_entropy("text"), 6).alias("entropy"))


#: Patterns by line in RE2, which knows no look-behind: the character before is part of the match.
_RE2 = {
    "eval": ("m", r"(?:^|[^A-Za-z0-9_$.])eval\s*\("),
    "debugger": ("m", r"(?:^|[^A-Za-z0-9_$])debugger\b"),
    "console-log": ("m", r"(?:^|[^A-Za-z0-9_$])console\.(?:log|warn|error|info|debug)\s*\("),
    "alert": ("m", r"(?:^|[^A-Za-z0-9_$.])alert\s*\("),
    "hardcoded-secret": ("q", "(?i)(?:^|[^a-z_])(?:api_key|apikey|secret|password|passwd|auth_token|access_token|private_key)\\s*[=:]\\s*[''\"`]\\x02{8,}[''\"`]"),
    "empty-catch": ("m", r"(?:^|[^A-Za-z0-9_$])catch\s*(?:\((?:[^()]|\([^()]*\))*\)\s*)?\{[\s\x01]*(?:\{[\s\x01]*\}[\s\x01]*)*\}"),
}
_HITS = " UNION ALL ".join(f"SELECT file_path, line, '{p}' AS pattern, len(regexp_extract_all(x, '{regex}')) AS n FROM (SELECT file_path, unnest(string_split({c}, chr(10))) AS x, generate_subscripts(string_split({c}, chr(10)), 1) AS line FROM masked)" for p, (c, regex) in _RE2.items())
_BY_LINE = f"hits AS (SELECT file_path, CAST(line AS INTEGER) AS line, pattern, CAST(n AS BIGINT) AS n FROM ({_HITS}) WHERE n > 0)"


def _pattern_query(name: str, pattern: str | None):
    def run(spark, sf_dir):
        return rules.pattern_hits(code(spark, sf_dir), pattern).groupBy("file_path", "line", "pattern").agg(F.count("*").alias("n"))

    run.__name__ = name
    only = f" WHERE pattern = '{pattern}'" if pattern else ""
    query(f"WITH {_MASKED}, {_BY_LINE} SELECT * FROM hits{only}")(run)


for _name, _pattern in (("pattern_eval", "eval"), ("pattern_debugger", "debugger"), ("pattern_console", "console-log"), ("pattern_empty_catch", "empty-catch"), ("pattern_secret", "hardcoded-secret"), ("pattern_alert", "alert"), ("pattern_all", None)):
    _pattern_query(_name, _pattern)

_PLACES = " UNION ALL ".join(
    f"SELECT file_path, line, k AS col, '{p}' AS pattern, substr(s, k, 80) AS snippet FROM (SELECT file_path, line, s, chr(3) || {c} AS y, unnest(range(1, len({c}) + 1)) AS k FROM lines WHERE regexp_matches({c}, '{regex}')) WHERE regexp_matches(substr(y, k), '{regex.replace("(?:^|", "^(?:", 1)}')"
    for p, (c, regex) in _RE2.items()
)


@query(
    f"""WITH {_MASKED}, lines AS (SELECT file_path, unnest(string_split(content, chr(10))) AS s, unnest(string_split(m, chr(10))) AS m, unnest(string_split(q, chr(10))) AS q, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM masked),
places AS ({_PLACES}) SELECT file_path, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, pattern, snippet FROM places"""
)
def pattern_places(spark, sf_dir):
    """Every hit with its line, column and snippet. The SQL tries all columns of a line."""
    return rules.pattern_hits(code(spark, sf_dir)).select("file_path", "line", "col", "pattern", "snippet")


_SPECS = "specs(pattern, rule, severity) AS (VALUES " + ", ".join(f"('{p}', 'sievecast/{r}', '{s}')" for p, r, _, s, _ in rules.RULE_SPECS) + ")"


@query(f"WITH {_MASKED}, {_BY_LINE}, {_SPECS} SELECT rule, severity, CAST(sum(n) AS BIGINT) AS n FROM hits JOIN specs USING (pattern) GROUP BY rule, severity")
def rule_lookup(spark, sf_dir):
    hits = rules.pattern_hits(code(spark, sf_dir))
    return rules.pattern_matches(hits, rules.rule_specs(spark)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


_THRESHOLDS = f"""{_MASKED}, {_SPLIT}, cost AS (SELECT file_path, sum(CASE WHEN t NOT IN ('{{', '}}') THEN 1 + depth ELSE 0 END) AS c FROM deep GROUP BY file_path),
cyc AS (SELECT file_path, 1 + len(list_filter({_CODE_TOKENS}, lambda t: t IN ('if', 'while', 'for', 'case', '&&', '||', '?'))) AS c FROM masked),
issues AS (SELECT file_path, 'sievecast/high-complexity' AS rule, CASE WHEN c > 40 THEN 'error' ELSE 'warning' END AS severity FROM cyc WHERE c > 15
  UNION ALL SELECT file_path, 'sievecast/high-cognitive-complexity', CASE WHEN c > 50 THEN 'error' ELSE 'warning' END FROM cost WHERE c > 25)"""


@query(f"WITH {_THRESHOLDS} SELECT * FROM issues")
def threshold_rules(spark, sf_dir):
    return rules.threshold_matches(rules.file_metrics(code(spark, sf_dir))).select("file_path", "rule", "severity")


@query(
    f"""WITH {_THRESHOLDS}, {_BY_LINE}, {_SPECS},
everything AS (SELECT file_path, severity, n FROM hits JOIN specs USING (pattern) UNION ALL SELECT file_path, severity, 1 FROM issues),
c AS (SELECT file_path, sum(n) FILTER (severity = 'error') AS n_error, sum(n) FILTER (severity = 'warning') AS n_warning, sum(n) FILTER (severity = 'info') AS n_info, sum(n) FILTER (severity = 'hint') AS n_hint, sum(n) AS n_issues FROM everything GROUP BY file_path)
SELECT code.file_path, CASE WHEN n_error > 0 THEN 'error' WHEN n_warning > 0 THEN 'warning' WHEN n_issues > 0 THEN 'info' ELSE 'clean' END AS highest,
  CAST(coalesce(n_error, 0) AS BIGINT) AS n_error, CAST(coalesce(n_warning, 0) AS BIGINT) AS n_warning, CAST(coalesce(n_info, 0) AS BIGINT) AS n_info, CAST(coalesce(n_hint, 0) AS BIGINT) AS n_hint, CAST(coalesce(n_issues, 0) AS BIGINT) AS n_issues
FROM code LEFT JOIN c ON code.file_path = c.file_path"""
)
def dir_summary(spark, sf_dir):
    """The flagship: scan, guard, mask, metrics, rules, summary by file."""
    files = sources.guarded(code(spark, sf_dir))
    return report.directory_summary(rules.match_arrays(files))


@query(
    """WITH v AS (SELECT o_orderkey, CAST(o_orderkey % 13 AS INT) AS a, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 13 END AS INT) AS b, (o_orderkey % 80) / 10.0 AS ea, (o_custkey % 80) / 10.0 AS eb FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS file_path, 'sievecast/deep-nesting' AS rule, CASE WHEN a > 10 THEN 'error' ELSE 'warning' END AS severity FROM v WHERE a > 6 AND coalesce(b, 0) <= 6
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'sievecast/high-entropy', 'info' FROM v WHERE ea > 6.5 AND eb <= 6.5"""
)
def delta_facts(spark, sf_dir):
    v = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS file_path", "CAST(o_orderkey % 13 AS INT) AS nesting_after", "CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 13 END AS INT) AS nesting_before", "(o_orderkey % 80) / 10.0 AS entropy_after", "(o_custkey % 80) / 10.0 AS entropy_before")
    return rules.crossing_facts(v)


_CHANGED = f"""{EDITS_SQL}, a AS (SELECT file_path, before, unnest(string_split(after, chr(10))) AS x, generate_subscripts(string_split(after, chr(10)), 1) AS line FROM edits),
b AS (SELECT DISTINCT file_path, unnest(string_split(before, chr(10))) AS x FROM edits WHERE before <> ''),
changed AS (SELECT a.file_path, CAST(line AS INTEGER) AS line FROM a LEFT JOIN b ON a.file_path = b.file_path AND a.x = b.x WHERE b.x IS NULL AND (before <> '' OR a.x <> ''))"""


@query(f"WITH {_CHANGED} SELECT * FROM changed")
def changed_lines(spark, sf_dir):
    return diff.changed_lines(edits(spark, sf_dir))


@query(f"WITH {_CHANGED} SELECT file_path, min(line) AS first_line, max(line) AS last_line FROM changed GROUP BY file_path")
def changed_range(spark, sf_dir):
    return diff.line_range(edits(spark, sf_dir))


@query(f"WITH {_CHANGED}, {_MASKED}, {_BY_LINE} SELECT h.file_path, CAST(sum(n) AS BIGINT) AS n_preexisting FROM hits h LEFT JOIN changed c ON h.file_path = c.file_path AND h.line = c.line WHERE c.line IS NULL GROUP BY h.file_path")
def preexisting_count(spark, sf_dir):
    hits = rules.pattern_matches(rules.pattern_hits(code(spark, sf_dir)), rules.rule_specs(spark))
    return diff.preexisting_counts(hits, edits(spark, sf_dir))


@query(f"WITH {_CHANGED}, {_MASKED}, {_BY_LINE} SELECT h.file_path, h.line, pattern, n FROM hits h JOIN changed c ON h.file_path = c.file_path AND h.line = c.line")
def new_matches(spark, sf_dir):
    hits = rules.pattern_hits(code(spark, sf_dir)).withColumn("rule", F.col("pattern"))
    found = diff.new_matches(hits, edits(spark, sf_dir), hits.filter("false"))
    return found.groupBy("file_path", "line", "pattern").agg(F.count("*").alias("n"))


_SUPPRESSED = f"""sup AS (SELECT file_path, regexp_extract(x, 'disable-(line|next-line|file)', 1) AS kind, line, trim(regexp_extract(x, 'disable-(?:line|next-line|file)(.*)', 1)) AS rest
  FROM (SELECT file_path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM code) WHERE regexp_matches(x, '(//|#)\\s*sievecast-disable-')),
suppressions AS (SELECT file_path, CASE kind WHEN 'file' THEN 'file' ELSE 'line' END AS scope, CAST(CASE kind WHEN 'file' THEN 0 WHEN 'next-line' THEN line + 1 ELSE line END AS INTEGER) AS line,
  unnest(CASE WHEN rest = '' THEN ['*'] ELSE regexp_split_to_array(rest, '[\\s,]+') END) AS rule FROM sup)"""


@query(f"WITH {CODE_SQL}, {_SUPPRESSED} SELECT * FROM suppressions")
def suppress_parse(spark, sf_dir):
    return suppress.parse_suppressions(code(spark, sf_dir))


@query(
    f"""WITH {_MASKED}, {_BY_LINE}, {_SPECS}, {_SUPPRESSED} SELECT h.file_path, h.line, h.pattern, h.n FROM hits h JOIN specs USING (pattern)
WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.file_path = h.file_path AND (s.scope = 'file' OR s.line = h.line) AND (s.rule = '*' OR s.rule = string_split(specs.rule, '/')[-1]))"""
)
def suppress_apply(spark, sf_dir):
    files = code(spark, sf_dir)
    hits = rules.pattern_hits(files).join(rules.rule_specs(spark), "pattern")
    return suppress.unsuppressed(hits, suppress.parse_suppressions(files)).groupBy("file_path", "line", "pattern").agg(F.count("*").alias("n"))


_GUARDED = "concat('p', CAST(o_orderkey AS STRING), CASE o_orderkey % 5 WHEN 0 THEN '/yarn.lock' WHEN 1 THEN '.min.js' WHEN 2 THEN '.js.map' ELSE '.ts' END)"
_NUL = "CASE WHEN o_orderkey % 7 = 0 THEN concat('a', chr(0)) ELSE 'a' END"


@query(f"SELECT {_GUARDED} AS file_path FROM orders WHERE o_orderkey % 5 > 2 AND o_orderkey % 7 <> 0")
def guard_filter(spark, sf_dir):
    return sources.guarded(table(spark, sf_dir, "orders").selectExpr(f"{_GUARDED} AS file_path", f"{_NUL} AS content")).select("file_path")


def _output(spark, sf_dir, tool: str, fmt: str, stdout) -> DataFrame:
    """Output of a tool over each order, made of its line items."""
    return diagnostics(spark, sf_dir).groupBy("file_path").agg(stdout.alias("stdout")).select("file_path", F.lit(tool).alias("tool"), F.lit(fmt).alias("format"), "stdout")


_PARSED = "SELECT file_path, '{tool}' AS tool, line, {col} AS col, {severity} AS severity, {rule} AS rule, message, {fix} AS has_fix FROM d"


def _parsed(tool: str, col: str = "col", severity: str = "severity", rule: str = "rule", fix: str = "false") -> str:
    return f"WITH {DIAGNOSTICS_SQL} " + _PARSED.format(tool=tool, col=col, severity=severity, rule=rule, fix=fix)


def _list(*fields):
    return F.collect_list(F.struct(*fields))


@query(_parsed("eslint", severity="CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END", fix="has_fix"))
def parse_eslint(spark, sf_dir):
    m = _list(F.col("rule").alias("ruleId"), "message", F.when(F.col("severity") == "error", 2).otherwise(1).alias("severity"), "line", F.col("col").alias("column"), F.when(F.col("has_fix"), F.struct(F.lit("x").alias("text"))).alias("fix"))
    noise = F.array(F.struct(F.lit(None).cast("string").alias("ruleId"), F.lit("File ignored by default").alias("message"), F.lit(1).alias("severity"), F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit(None).cast("struct<text:string>").alias("fix")))
    return parsers.eslint(_output(spark, sf_dir, "eslint", "eslint", F.to_json(F.array(F.struct(F.concat(m, noise).alias("messages"))))))


@query(_parsed("biome"))
def parse_generic_json(spark, sf_dir):
    return parsers.generic_json(_output(spark, sf_dir, "biome", "json", F.to_json(F.struct(_list("line", F.col("col").alias("column"), "severity", "rule", "message").alias("issues")))))


@query(_parsed("prettier", rule="'prettier'"))
def parse_generic_text(spark, sf_dir):
    line = F.concat(F.lit("x.ts "), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit("  "), F.upper("severity"), F.lit("  "), F.col("message"))
    return parsers.generic_text(_output(spark, sf_dir, "prettier", "generic", F.concat(F.lit("File ignored: 1:1 error x\n"), F.array_join(F.collect_list(line), "\n"))))


@query(_parsed("tsc", severity="CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END", rule="CASE severity WHEN 'error' THEN 'tsc/error' ELSE 'tsc/warning' END"))
def parse_tsc(spark, sf_dir):
    kind = F.when(F.col("severity") == "error", "error").otherwise("warning")
    line = F.concat(F.col("file_path"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit(" - "), kind, F.lit(" TS2322: "), F.col("message"))
    return parsers.tsc(_output(spark, sf_dir, "tsc", "tsc", F.array_join(F.collect_list(line), "\n")))


@query(_parsed("mypy", severity="CASE severity WHEN 'info' THEN 'info' WHEN 'warning' THEN 'warning' ELSE 'error' END"))
def parse_mypy(spark, sf_dir):
    kind = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    return parsers.mypy(_output(spark, sf_dir, "mypy", "mypy-json", F.to_json(_list(kind.alias("severity"), F.col("rule").alias("code"), "line", F.col("col").alias("column"), "message"))))


@query(_parsed("cargo-check", severity="CASE severity WHEN 'error' THEN 'error' WHEN 'info' THEN 'info' ELSE 'warning' END", rule="concat('rustc/', rule)"))
def parse_cargo(spark, sf_dir):
    level = F.when(F.col("severity") == "info", "note").when(F.col("severity") == "hint", "warning").otherwise(F.col("severity"))
    spans = F.array(F.struct(F.col("file_path").alias("file_name"), F.col("line").alias("line_start"), F.col("col").alias("column_start")))
    line = F.to_json(F.struct("message", level.alias("level"), spans.alias("spans"), F.struct(F.col("rule").alias("code")).alias("code")))
    return parsers.cargo(_output(spark, sf_dir, "cargo-check", "cargo-json", F.concat(F.lit("not json\n"), F.array_join(F.collect_list(line), "\n"))))


@query(_parsed("pyright"))
def parse_pyright(spark, sf_dir):
    kind = F.when(F.col("severity") == "info", "information").when(F.col("severity") == "hint", "message").otherwise(F.col("severity"))
    place = F.struct(F.struct("line", F.col("col").alias("character")).alias("start"))
    return parsers.pyright(_output(spark, sf_dir, "pyright", "pyright-json", F.to_json(F.struct(_list("message", "rule", kind.alias("severity"), place.alias("range")).alias("generalDiagnostics")))))


@query(_parsed("semgrep", severity="CASE severity WHEN 'error' THEN 'error' WHEN 'info' THEN 'info' ELSE 'warning' END"))
def parse_semgrep(spark, sf_dir):
    r = _list(F.col("rule").alias("check_id"), F.upper("severity").alias("severity"), F.col("file_path").alias("path"), F.struct("line", "col").alias("start"), F.struct("message").alias("extra"))
    return parsers.semgrep(_output(spark, sf_dir, "semgrep", "semgrep", F.to_json(F.struct(r.alias("results")))))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'hint' ELSE 'info' END AS severity FROM events")
def severity_map(spark, sf_dir):
    raw = F.when(F.col("event_type") == "error", "FATAL").when(F.col("event_type") == "view", "Warn").when(F.col("event_type") == "signup", "hint").when(F.col("event_type") == "click", None).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", parsers.map_severity(raw).alias("severity"))


_SCORES = f"""{DIAGNOSTICS_SQL}, s AS (SELECT *, CASE severity WHEN 'error' THEN 100 WHEN 'warning' THEN 50 WHEN 'info' THEN 20 ELSE 10 END AS s_severity,
  CASE WHEN touched_start < 0 THEN 50.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE * (1.0::DOUBLE - (CASE WHEN line < touched_start THEN touched_start - line WHEN line > touched_end THEN line - touched_end ELSE 0 END)::DOUBLE / 50.0::DOUBLE)) END AS s_proximity,
  CASE WHEN blast_radius <= 0 THEN 0 WHEN blast_radius = 1 THEN 30 WHEN blast_radius <= 3 THEN 60 WHEN blast_radius <= 10 THEN 85 ELSE 100 END AS s_blast,
  CASE WHEN NOT has_fix THEN 0 WHEN fix_count <= 0 THEN 30 WHEN fix_count = 1 THEN 80 ELSE 100 END AS s_fix, least(age * 2, 20) AS s_age FROM d),
scored AS (SELECT *, round(least(100, greatest(0, 0.4::DOUBLE * s_severity + 0.25::DOUBLE * s_proximity + 0.2::DOUBLE * s_blast + 0.1::DOUBLE * s_fix - s_age)), 4) AS score FROM s)"""


def _scored(spark, sf_dir) -> DataFrame:
    d = diagnostics(spark, sf_dir).withColumns({"s_severity": score.severity_weight(F.col("severity")), "s_proximity": score.proximity(F.col("line"), F.col("touched_start"), F.col("touched_end")), "s_blast": score.blast(F.col("blast_radius")), "s_fix": score.fixability(F.col("has_fix"), F.col("fix_count")), "s_age": score.age_penalty(F.col("age"))})
    return d.withColumn("score", F.round(score.total(F.col("s_severity"), F.col("s_proximity"), F.col("s_blast"), F.col("s_fix"), F.col("s_age")), 4))


@query(f"WITH {_SCORES} SELECT id, s_severity, round(s_proximity, 4) AS s_proximity, s_blast, s_fix, s_age FROM s")
def score_components(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "s_severity", F.round("s_proximity", 4).alias("s_proximity"), "s_blast", "s_fix", "s_age")


@query(f"WITH {_SCORES} SELECT id, score FROM scored")
def score_total(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "score")


@query("SELECT CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS id, round(greatest(0, 100.0::DOUBLE * (1.0::DOUBLE - least(abs(l_partkey % 90 - l_suppkey % 40), abs(l_partkey % 90 - (l_suppkey % 40 + 30)))::DOUBLE / 50.0::DOUBLE)), 4) AS near FROM lineitem")
def score_nearest_line(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").selectExpr("concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS id", "l_partkey % 90 AS line", "array(l_suppkey % 40, l_suppkey % 40 + 30) AS touched")
    return d.select("id", F.round(score.proximity(F.col("line"), F.lit(0), F.lit(100), F.col("touched")), 4).alias("near"))


@query(f"WITH {DIAGNOSTICS_SQL} SELECT file_path, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info, count(*) FILTER (severity = 'hint') AS n_hint FROM d GROUP BY file_path")
def count_severities(spark, sf_dir):
    return report.count_severities(diagnostics(spark, sf_dir), "file_path")


@query(f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, line, id, severity, rule, message, file_path) AS rank, max(score) OVER (PARTITION BY session_id) AS file_score, greatest(count(*) OVER (PARTITION BY session_id) - 20, 0) AS more FROM scored)
SELECT session_id AS file_path, id, score, CAST(rank AS INTEGER) AS rank, file_score, more FROM r WHERE rank <= 20""")
def file_ranking_topk(spark, sf_dir):
    return report.top_by_file(_scored(spark, sf_dir).withColumn("file_path", F.col("session_id"))).select("file_path", "id", "score", "rank", "file_score", "more")


@query(f"WITH {DIAGNOSTICS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, id, severity, rule, message, file_path) AS rank FROM d WHERE status = 'resolved') SELECT session_id, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def resolved_topk(spark, sf_dir):
    return report.top_resolved(diagnostics(spark, sf_dir)).select("session_id", "id", "rank")


@query(f"WITH {DIAGNOSTICS_SQL} SELECT file_path, CASE WHEN bool_or(severity = 'error') THEN 'major' ELSE 'minor' END AS status FROM d GROUP BY file_path")
def status_rollup(spark, sf_dir):
    return report.overall_status(diagnostics(spark, sf_dir), "file_path")


@query(f"WITH {DIAGNOSTICS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY file_path, line, id, severity, rule, message, file_path) AS rank, greatest(count(*) OVER (PARTITION BY severity) - 5, 0) AS more FROM d) SELECT severity, id, CAST(rank AS INTEGER) AS rank, more FROM r WHERE rank <= 5")
def widget_groups(spark, sf_dir):
    return report.widget(diagnostics(spark, sf_dir)).select("severity", "id", "rank", "more")


@query(
    f"""WITH {DIAGNOSTICS_SQL}, n AS (SELECT session_id, count(*) FILTER (status <> 'resolved') AS n, count(*) FILTER (status <> 'resolved' AND severity = 'error') AS e, count(*) FILTER (status <> 'resolved' AND severity = 'warning') AS w,
  count(*) FILTER (status <> 'resolved' AND severity = 'info') AS i, count(*) FILTER (status <> 'resolved' AND severity = 'hint') AS h, count(*) FILTER (status = 'resolved') AS r FROM d GROUP BY session_id)
SELECT session_id, concat('Active: ', n, CASE WHEN e + w + i + h + r > 0 THEN concat(' (', concat_ws(', ', CASE WHEN e > 0 THEN concat(e, ' error') END, CASE WHEN w > 0 THEN concat(w, ' warning') END, CASE WHEN i > 0 THEN concat(i, ' info') END, CASE WHEN h > 0 THEN concat(h, ' hint') END, CASE WHEN r > 0 THEN concat(r, ' resolved') END), ')') ELSE '' END) AS header FROM n"""
)
def report_header(spark, sf_dir):
    return report.header(diagnostics(spark, sf_dir), "session_id")


@query(
    f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, line, id, severity, rule, message, file_path) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM scored)
SELECT session_id AS file_path, max(score) AS file_score, concat('### ', session_id, chr(10), string_agg(concat('- ', severity, CASE WHEN line > 0 THEN concat(' L', line) ELSE '' END, ': ', message, ' (', rule, ')'), chr(10) ORDER BY k), CASE WHEN max(n) > 20 THEN concat(chr(10), '+', max(n) - 20, ' more') ELSE '' END) AS section FROM r WHERE k <= 20 GROUP BY session_id"""
)
def report_sections(spark, sf_dir):
    return report.file_sections(_scored(spark, sf_dir).withColumn("file_path", F.col("session_id")))


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN concat('u', p_partkey) ELSE concat('d', p_partkey) END AS name, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'user' ELSE 'default' END AS origin FROM part")
def config_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    defaults = p.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("d"), "p_partkey").alias("name"), F.lit("default").alias("origin"))
    user = p.filter("p_partkey % 3 = 0 OR p_partkey % 5 = 0").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "u").otherwise("d"), "p_partkey").alias("name"), F.lit("user").alias("origin"))
    return config.merge(defaults, user)


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS rules, p_size AS timeout FROM part")
def config_overlay(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.col("p_partkey").cast("string"))
    user = p.filter("p_partkey % 2 = 0").select("name", F.col("p_brand").alias("rules"), F.lit(None).cast("int").alias("timeout"))
    return config.overlay(p.select("name", F.col("p_type").alias("rules"), F.col("p_size").alias("timeout")), user)


_TOOLS = "tools(name, ext) AS (VALUES " + ", ".join(f"('{n}', '{e}')" for n, _, ends in config.LINTERS for e in ends) + ")"


@query(f"WITH {CODE_SQL}, {_TOOLS} SELECT file_path, name FROM code JOIN tools ON suffix(file_path, ext)")
def tool_applicability(spark, sf_dir):
    return config.applicable(code(spark, sf_dir), config.tools(spark))


@query("""WITH f AS (SELECT concat('src/m', o_orderkey % 9, '/f', o_orderkey % 500, '.ts') AS file_path FROM orders), r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('src/m', o_orderkey % 9, '/f', o_orderkey % 500, '.ts') WHEN 1 THEN concat('/tmp/x/f', o_orderkey % 500, '.ts') ELSE concat('other/', o_orderkey, '.go') END AS reported_path FROM orders),
n AS (SELECT string_split(file_path, '/')[-1] AS name, min(file_path) AS first FROM f GROUP BY 1)
SELECT o_orderkey, coalesce(e.file_path, n.first, reported_path) AS file_path FROM r LEFT JOIN (SELECT DISTINCT file_path FROM f) e ON reported_path = e.file_path LEFT JOIN n ON string_split(reported_path, '/')[-1] = n.name""")
def semgrep_path_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = "concat('src/m', CAST(o_orderkey % 9 AS STRING), '/f', CAST(o_orderkey % 500 AS STRING), '.ts')"
    findings = o.selectExpr("o_orderkey", f"CASE o_orderkey % 3 WHEN 0 THEN {own} WHEN 1 THEN concat('/tmp/x/f', CAST(o_orderkey % 500 AS STRING), '.ts') ELSE concat('other/', CAST(o_orderkey AS STRING), '.go') END AS reported_path")
    return parsers.match_paths(findings, o.selectExpr(f"{own} AS file_path")).select("o_orderkey", "file_path")


@query("SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS severity FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    return lifecycle.latest(table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS id", "event_id AS seq", "event_type AS severity"))


@query(f"""WITH {DIAGNOSTICS_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY session_id) - 500 AS over_, row_number() OVER (PARTITION BY session_id, status = 'resolved' ORDER BY last_seen, id, severity, rule, message, file_path) AS k FROM d)
SELECT session_id, id, status FROM r WHERE NOT (status = 'resolved' AND k <= over_)""")
def evict_resolved(spark, sf_dir):
    return lifecycle.evict(diagnostics(spark, sf_dir)).select("session_id", "id", "status")


_PASSES = "e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS file_path, event_id AS pass, concat(CAST(user_id % 50 AS VARCHAR), ':', event_type) AS id, value > 40 AS hit FROM events)"


@query(f"""WITH {_PASSES}, l AS (SELECT id, file_path, max(pass) AS last_seen FROM e WHERE hit GROUP BY id, file_path)
SELECT l.id, l.file_path, last_seen, CASE WHEN min(e.pass) IS NULL THEN 'emitted' ELSE 'resolved' END AS status, min(e.pass) AS resolved_at FROM l LEFT JOIN e ON e.file_path = l.file_path AND e.pass > last_seen GROUP BY l.id, l.file_path, last_seen""")
def lifecycle_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("CAST(user_id % 50 AS STRING) AS file_path", "event_id AS pass", "concat(CAST(user_id % 50 AS STRING), ':', event_type) AS id", "value > 40 AS hit")
    return lifecycle.status(e.select("file_path", "pass"), e.filter("hit").select("file_path", "pass", "id"))


_TURNS = "t AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'turn_end' ELSE 'tool_call' END AS kind, CAST(event_id % 5 AS VARCHAR) AS file_path, props AS content FROM events), a AS (SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'turn_end' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS turn FROM t)"


def _turns(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS session_id", "event_id AS seq", "CASE event_type WHEN 'view' THEN 'turn_end' ELSE 'tool_call' END AS kind", "'edit' AS tool_name", "CAST(event_id % 5 AS STRING) AS file_path", "props AS content")
    return lifecycle.assign_turns(e)


@query(f"WITH {_TURNS} SELECT session_id, seq, turn FROM a")
def turn_assignment(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "seq", "turn")


@query(f"WITH {_TURNS} SELECT session_id, turn, file_path, arg_min(content, seq) AS content FROM a WHERE kind = 'tool_call' GROUP BY session_id, turn, file_path")
def snapshot_first_write(spark, sf_dir):
    return lifecycle.first_snapshots(_turns(spark, sf_dir))


@query(f"WITH {DIAGNOSTICS_SQL} SELECT DISTINCT file_path FROM d WHERE status <> 'resolved' AND has_fix")
def autofix_candidates(spark, sf_dir):
    return config.fix_candidates(diagnostics(spark, sf_dir))


@query("""WITH c AS (SELECT l_orderkey, max(l_linenumber) FILTER (l_returnflag <> 'R') AS last, min(l_linenumber) AS first FROM lineitem GROUP BY l_orderkey)
SELECT CAST(c.l_orderkey AS VARCHAR) AS file_path, CASE WHEN last IS NULL THEN concat('before ', first) ELSE concat('after ', last) END AS content FROM c""")
def autofix_chain(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS file_path", "l_linenumber AS step", "concat('before ', CAST(l_linenumber AS STRING)) AS before", "concat('after ', CAST(l_linenumber AS STRING)) AS after", "l_returnflag <> 'R' AS ok")
    return config.chain_fixers(runs)


_PREFIX = "coalesce(list_min(list_filter(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[k] <> {b}[k])) - 1, least(len({a}), len({b})))"


@query(
    f"""WITH p AS (SELECT o_orderkey, concat(o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR)) AS a, concat(o_orderpriority, CAST(o_orderkey % 7 AS VARCHAR), CAST(o_custkey AS VARCHAR)) AS b FROM orders),
h AS (SELECT *, reverse(a) AS ra, reverse(b) AS rb, {_PREFIX.format(a="a", b="b")} AS head FROM p), t AS (SELECT *, {_PREFIX.format(a="ra", b="rb")} AS tail FROM h)
SELECT o_orderkey, CAST(greatest(len(a), len(b)) - head - least(tail, ceil((least(len(a), len(b)) - head) / 2.0)) AS INTEGER) AS n FROM t"""
)
def char_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(o_orderpriority, o_orderstatus, CAST(o_custkey AS STRING)) AS a", "concat(o_orderpriority, CAST(o_orderkey % 7 AS STRING), CAST(o_custkey AS STRING)) AS b")
    return o.select("o_orderkey", text.char_diff(F.col("a"), F.col("b")).alias("n"))


@query(
    f"""WITH {EDITS_SQL}, n AS (SELECT *, len(after) - len(replace(after, chr(10), '')) - len(before) + len(replace(before, chr(10), '')) AS lines FROM edits)
SELECT file_path, concat(CASE WHEN lines > 0 THEN '+' WHEN lines = 0 THEN '±' ELSE '' END, lines, ' lines (', len(before), ' → ', len(after), ' bytes)') AS summary FROM n"""
)
def autofix_summary(spark, sf_dir):
    return edits(spark, sf_dir).select("file_path", text.change_summary(F.col("before"), F.col("after")).alias("summary"))


@query(f"WITH {CODE_SQL} SELECT file_path, CAST((len(content) - len(replace(content, 'if (', ''))) / 4 AS INTEGER) AS n FROM code")
def match_count(spark, sf_dir):
    return code(spark, sf_dir).select("file_path", text.count_matches(F.col("content"), F.lit("if (")).alias("n"))


_NEEDLE = "concat(';', chr(10), '    debugger;')"


@query(f"WITH {CODE_SQL}, f AS (SELECT file_path, rtrim(content, ' ') AS content, instr(content, 'debugger;') AS p FROM code) SELECT file_path, CASE WHEN p > 0 THEN CAST(1 + len(content[1:p - 1]) - len(replace(content[1:p - 1], chr(10), '')) AS INTEGER) END AS first_line FROM f")
def match_range(spark, sf_dir):
    return code(spark, sf_dir).select("file_path", text.match_range(F.col("content"), F.lit("debugger;"))["first_line"].alias("first_line"))


@query("SELECT p_partkey, concat('\t', p_name, chr(10), '\t', p_type) AS fixed FROM part")
def correct_indent(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.correct_indentation(F.concat(F.lit("\t"), "p_brand", F.lit("\n\t"), "p_name"), F.concat(F.lit("    "), "p_name", F.lit("\n      "), "p_type")).alias("fixed"))


@query("SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'warning') AS severity, 0 AS line, CAST(coalesce(CASE WHEN event_id % 2 = 0 THEN user_id % 20 END, 1) AS INTEGER) AS blast_radius FROM events")
def coerce_defaults(spark, sf_dir):
    raw = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(NULL AS STRING) AS id", "'f' AS file_path", "CASE WHEN event_type <> 'view' THEN event_type END AS severity", "CAST(NULL AS INT) AS line", "CAST(NULL AS INT) AS col", "'r' AS rule", "'m' AS message", "CAST(CASE WHEN event_id % 2 = 0 THEN user_id % 20 END AS INT) AS blast_radius")
    return lifecycle.coerce(raw).select("event_id", "severity", "line", "blast_radius")


_MASKED_LINES = "lines AS (SELECT file_path, CAST(generate_subscripts(s, 1) AS INTEGER) AS line, unnest(s) AS x FROM (SELECT file_path, string_split(m, chr(10)) AS s FROM masked))"


@query(f"WITH {_MASKED}, {_MASKED_LINES} SELECT file_path, line, 'sievecast/xss-innerhtml' AS rule FROM lines WHERE regexp_matches(x, 'innerHTML *=')")
def syntax_inner_html(spark, sf_dir):
    return syntax.dangerous_calls(code(spark, sf_dir)).filter("rule = 'sievecast/xss-innerhtml'").select("file_path", "line", "rule")


@query(f"WITH {CODE_SQL} SELECT file_path, concat('f', regexp_extract(file_path, 'f([0-9]+)', 1), ' has ', CAST(2 + CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT) % 9 AS VARCHAR), ' parameters') AS message, CASE WHEN CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT) % 9 > 6 THEN 'error' ELSE 'warning' END AS severity FROM code WHERE CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT) % 9 > 3")
def syntax_long_params(spark, sf_dir):
    return syntax.long_parameter_lists(code(spark, sf_dir)).select("file_path", "message", "severity")


@query(
    f"""WITH {_MASKED}, {_MASKED_LINES}, c AS (SELECT file_path, line, 'sievecast/eval-detected' AS rule, len(regexp_extract_all(x, '\\beval\\s*\\(')) AS n FROM lines
UNION ALL SELECT file_path, line, 'sievecast/xss-innerhtml', len(regexp_extract_all(x, '\\.innerHTML\\s*=[^=]')) FROM lines), own AS (SELECT file_path, string_split(content, chr(10)) AS s FROM code)
SELECT file_path, line, rule, trim(s[line], ' ') AS snippet, n FROM c JOIN own USING (file_path) WHERE n > 0"""
)
def syntax_dangerous(spark, sf_dir):
    return syntax.dangerous_calls(code(spark, sf_dir)).groupBy("file_path", "line", "rule", "snippet").agg(F.count("*").alias("n"))


@query(f"WITH {_MASKED}, {_MASKED_LINES} SELECT file_path, line, concat('magic number ', unnest(regexp_extract_all(x, '(?:^|[^A-Za-z0-9_$.])([0-9]{{2,}})', 1))) AS message FROM lines")
def syntax_numbers(spark, sf_dir):
    return syntax.magic_numbers(code(spark, sf_dir)).select("file_path", "line", "message")


@query(f"WITH {CODE_SQL}, k AS (SELECT file_path, CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT) AS k FROM code) SELECT file_path, 2 AS line, 18 AS col, concat('c', k % 3, ' is imported and not used') AS message FROM k")
def syntax_unused_imports(spark, sf_dir):
    return syntax.unused_imports(code(spark, sf_dir)).select("file_path", "line", "col", "message")


@query(
    f"""WITH {CODE_SQL}, k AS (SELECT file_path, CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT) AS k FROM code), m AS (SELECT *, k % 8 AS m FROM k),
n AS (SELECT file_path, greatest(m - 3, 0) + CAST(k % 4 <> 1 AND m >= 3 AS INT) + (CAST(k % 7 < 2 AS INT) + CAST(k % 13 < 2 AS INT)) * (CAST(m >= 3 AS INT) + CAST(m >= 2 AS INT)) AS n FROM m)
SELECT file_path, CAST(n AS BIGINT) AS n FROM n WHERE n > 0"""
)
def syntax_nesting(spark, sf_dir):
    return syntax.deep_blocks(code(spark, sf_dir)).groupBy("file_path").agg(F.count("*").alias("n"))


_KEY = "CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT)"


@query(
    f"""WITH {_MASKED}, {_MASKED_LINES}, k AS (SELECT file_path, {_KEY} AS k FROM code), m AS (SELECT *, k % 8 AS m FROM k),
found AS (SELECT file_path, 'sievecast/eval-detected' AS rule, 'error' AS severity, unnest(regexp_extract_all(x, '\\beval\\s*\\(')) AS t FROM lines
UNION ALL SELECT file_path, 'sievecast/xss-innerhtml', 'warning', unnest(regexp_extract_all(x, '\\.innerHTML\\s*=[^=]')) FROM lines
UNION ALL SELECT file_path, 'sievecast/magic-number', 'hint', unnest(regexp_extract_all(x, '(?:^|[^A-Za-z0-9_$.])([0-9]{{2,}})', 1)) FROM lines
UNION ALL SELECT file_path, 'sievecast/unused-import', 'info', '' FROM k
UNION ALL SELECT file_path, 'sievecast/long-params', CASE WHEN k % 9 > 6 THEN 'error' ELSE 'warning' END, '' FROM k WHERE k % 9 > 3),
deep AS (SELECT file_path, unnest(range(5, m + 2)) AS depth FROM m
UNION ALL SELECT file_path, m + 2 FROM m WHERE k % 4 <> 1 AND m >= 3
UNION ALL SELECT file_path, m + unnest([2, 3]) FROM m WHERE k % 7 < 2 UNION ALL SELECT file_path, m + unnest([2, 3]) FROM m WHERE k % 13 < 2)
SELECT file_path, rule, severity, count(*) AS n FROM (SELECT file_path, rule, severity FROM found UNION ALL SELECT file_path, 'sievecast/deep-nesting', CASE WHEN depth > 6 THEN 'error' ELSE 'warning' END FROM deep WHERE depth > 4) GROUP BY file_path, rule, severity"""
)
def syntax_rules(spark, sf_dir):
    return syntax.all_rules(code(spark, sf_dir)).groupBy("file_path", "rule", "severity").agg(F.count("*").alias("n"))


# What the template of the sources makes of a query's captures, line by line.
@query(
    f"""WITH {_MASKED}, {_MASKED_LINES}, own AS (SELECT file_path, string_split(content, chr(10)) AS s FROM code),
found AS (SELECT file_path, line, x, unnest(regexp_extract_all(x, '[A-Za-z_]+\\.[A-Za-z_]+\\s*\\(')) AS t FROM lines)
SELECT file_path, line, CAST(strpos(x, t) + CASE c WHEN 'object' THEN 0 ELSE strpos(t, '.') END AS INTEGER) AS col, c AS capture, CASE c WHEN 'object' THEN split_part(t, '.', 1) ELSE regexp_extract(t, '\\.([A-Za-z_]+)', 1) END AS name, trim(s[line], ' ') AS snippet
FROM found JOIN own USING (file_path), (VALUES ('object'), ('method')) AS v(c)"""
)
def ast_query_captures(spark, sf_dir):
    """Method calls of plain names: a query with fields and two captures."""
    calls = "(call_expression function: (member_expression object: (identifier) @object property: (property_identifier) @method))"
    found = ast_query.run_query(ast_query.node_table(code(spark, sf_dir), calls).persist(), calls)
    return found.select("file_path", "line", "col", "capture", "name", "snippet")


@query(
    f"""WITH {_MASKED}, {_MASKED_LINES}, found AS (SELECT file_path, line, 'own/no-console' AS rule, 'warning' AS severity, len(regexp_extract_all(x, 'console\\.(log|warn)')) AS n FROM lines
UNION ALL SELECT file_path, line, 'own/no-debugger', 'info', len(regexp_extract_all(x, '\\bdebugger\\b')) FROM lines
UNION ALL SELECT file_path, line, 'own/empty-catch', 'error', len(regexp_extract_all(x, 'catch \\((?:e|f\\(x\\))\\) \\{{ \\}}')) FROM lines)
SELECT file_path, line, rule, severity, CAST(n AS BIGINT) AS n FROM found WHERE n > 0"""
)
def ast_query_rules(spark, sf_dir):
    """Custom rules, each a query: predicates, plain nodes, a block without statements."""
    rules = [
        ast_query.AstRule("console", '(call_expression function: (member_expression object: (identifier) @o property: (property_identifier) @p) (#eq? @o "console") (#any-of? @p "log" "warn"))', "console call", "warning", "own/no-console"),
        ast_query.AstRule("debugger", "(debugger_statement) @d", "debugger", "info", "own/no-debugger"),
        ast_query.AstRule("catch", "(catch_clause body: (statement_block) @b)", "empty catch", "error", "own/empty-catch"),
    ]
    nodes = ast_query.node_table(code(spark, sf_dir), *[r.query for r in rules]).filter("type <> 'statement_block' OR kids = 0")
    found, _ = ast_query.run_rules(nodes.persist(), rules)
    # a match of the first rule has two captures
    return found.groupBy("file_path", "line", "rule", "severity").agg(F.count("*").alias("_n")).select("file_path", "line", "rule", "severity", F.when(F.col("rule") == "own/no-console", (F.col("_n") / 2).cast("long")).otherwise(F.col("_n")).alias("n"))


@query(
    f"""WITH {CODE_SQL}, k AS (SELECT file_path, {_KEY} AS k FROM code), t AS (SELECT file_path, k, k % 8 AS m FROM k)
SELECT file_path, 'try_statement' AS type, CAST(CAST(k % 7 < 2 AS INT) + CAST(k % 13 < 2 AS INT) AS BIGINT) AS n FROM t WHERE k % 7 < 2 OR k % 13 < 2
UNION ALL SELECT file_path, 'while_statement', 1 FROM t WHERE k % 4 <> 1"""
)
def ast_contained(spark, sf_dir):
    """Nodes that stand in a function, at any depth, by intervals."""
    inside = syntax.contained(syntax.node_table(code(spark, sf_dir), ("function_declaration", "try_statement", "while_statement")), "function_declaration")
    return inside.filter("type <> 'function_declaration'").groupBy("file_path", "type").agg(F.count("*").alias("n"))


# Reports, harvests and configurations.
_REPORTED = "r AS (SELECT session_id, id, concat('src/g', CAST(CAST(split_part(id, ':', 1) AS BIGINT) % 3 AS STRING), '.ts') AS file_path, CASE WHEN line % 5 = 0 THEN 0 ELSE line END AS line, severity, message, rule, status, score, last_seen, CASE WHEN line % 3 = 0 THEN concat('s ', CAST(line AS STRING)) END AS snippet, CASE WHEN has_fix THEN concat('fix ', rule) END AS fix FROM {})"


@query(
    f"""WITH {_SCORES}, {_REPORTED.format("scored")},
a AS (SELECT *, row_number() OVER (PARTITION BY session_id, file_path ORDER BY score DESC, line, id, severity, rule, message, file_path) AS k, count(*) OVER (PARTITION BY session_id, file_path) AS n FROM r WHERE status <> 'resolved'),
sec AS (SELECT session_id, file_path, max(score) AS best, concat(chr(10), chr(10), file_path, ' (', max(n), CASE WHEN max(n) = 1 THEN ' issue)' ELSE ' issues)' END,
  string_agg(concat(chr(10), '- [', CASE severity WHEN 'error' THEN 'ERROR' WHEN 'warning' THEN 'WARN' WHEN 'info' THEN 'INFO' ELSE 'HINT' END, '] ', CASE WHEN line > 0 THEN concat('line ', line) ELSE 'whole file' END, ' — ', message, ' [', rule, ']',
    CASE WHEN snippet IS NOT NULL THEN concat(chr(10), '    ', snippet) ELSE '' END, CASE WHEN fix IS NOT NULL THEN concat(chr(10), '    Fix: ', fix) ELSE '' END), '' ORDER BY k),
  CASE WHEN max(n) > 20 THEN concat(chr(10), '- …and ', max(n) - 20, ' more in this file') ELSE '' END) AS section FROM a WHERE k <= 20 GROUP BY session_id, file_path),
f AS (SELECT session_id, string_agg(section, '' ORDER BY best DESC, file_path) AS files FROM sec GROUP BY session_id),
g AS (SELECT session_id, string_agg(concat(chr(10), '- ', file_path, CASE WHEN line > 0 THEN concat(':', line) ELSE '' END, ' — ', message, ' [', rule, ']'), '' ORDER BY k) AS gone FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, id, severity, rule, message, file_path) AS k FROM r WHERE status = 'resolved') WHERE k <= 10 GROUP BY session_id),
x AS (SELECT session_id, string_agg(concat(file_path, ' (eslint+', rule, ')'), ', ' ORDER BY file_path, rule) AS fixes FROM (SELECT DISTINCT session_id, file_path, rule FROM r WHERE fix IS NOT NULL AND CAST(session_id AS BIGINT) % 2 = 0) GROUP BY session_id),
c AS (SELECT session_id, count(*) FILTER (status <> 'resolved') AS n, count(*) FILTER (status = 'resolved') AS r, count(*) FILTER (status <> 'resolved' AND severity = 'error') AS e, count(*) FILTER (status <> 'resolved' AND severity = 'warning') AS w, count(*) FILTER (status <> 'resolved' AND severity = 'info') AS i, count(*) FILTER (status <> 'resolved' AND severity = 'hint') AS h FROM r GROUP BY session_id)
SELECT session_id, concat('Active: ', n, CASE WHEN n > 0 THEN concat(' (', concat_ws(', ', CASE WHEN e > 0 THEN concat(e, ' error') END, CASE WHEN w > 0 THEN concat(w, ' warning') END, CASE WHEN i > 0 THEN concat(i, ' info') END, CASE WHEN h > 0 THEN concat(h, ' hint') END), ')') ELSE '' END, '. Resolved: ', c.r, '.', coalesce(files, ''),
  CASE WHEN c.r > 0 THEN concat(chr(10), chr(10), 'Resolved this cycle (', c.r, '):', gone, CASE WHEN c.r > 10 THEN concat(chr(10), '- …and ', c.r - 10, ' more') ELSE '' END) ELSE '' END, CASE WHEN fixes IS NOT NULL THEN concat(chr(10), chr(10), 'Suggested fixes: ', fixes, '.') ELSE '' END,
  chr(10), chr(10), CASE WHEN n > 0 THEN 'Next: address the active issues above before continuing.' WHEN c.r > 0 THEN 'Next: clean run — keep going.' ELSE 'Next: review the suggested fixes; apply if appropriate.' END) AS report
FROM c LEFT JOIN f USING (session_id) LEFT JOIN g USING (session_id) LEFT JOIN x USING (session_id)"""
)
def diagnostic_report(spark, sf_dir):
    r = spark.sql(f"WITH {_REPORTED.format('{scored}')} SELECT * FROM r", scored=_scored(spark, sf_dir))
    fixes = r.filter("fix IS NOT NULL AND CAST(session_id AS BIGINT) % 2 = 0").select("session_id", "file_path", F.array(F.lit("eslint"), "rule").alias("fixers")).distinct()
    return report.diagnostic_report(r, fixes)


@query(
    f"""WITH {DIAGNOSTICS_SQL}, f AS (SELECT concat('src/g', CAST(session_id AS BIGINT) % 500, '.ts') AS file_path, line, col, rule, severity, message, CAST(session_id AS BIGINT) % 500 % 9 = 0 AS unread FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line, col, rule, severity, message) AS k FROM f),
n AS (SELECT file_path, bool_or(unread) AS unread, count(*) AS n, bool_or(severity = 'error') AS e, bool_or(severity = 'warning') AS w, string_agg(concat(chr(10), '    [', upper(severity), '] ', message, ' [', rule, ']', CASE WHEN line > 0 THEN concat(':', line) ELSE '' END), '' ORDER BY k) FILTER (k <= 10) AS shown FROM k GROUP BY file_path)
SELECT file_path, CASE WHEN NOT unread AND e THEN 'Errors' WHEN unread OR w THEN 'Warnings' ELSE 'Info' END AS label,
  CASE WHEN unread THEN concat('- `', file_path, '` — Cannot read file') ELSE concat('- `', file_path, '` (', n, ' issue(s))', shown, CASE WHEN n > 10 THEN concat(chr(10), '    ...and ', n - 10, ' more') ELSE '' END) END AS entry FROM n"""
)
def directory_report(spark, sf_dir):
    d = diagnostics(spark, sf_dir).withColumn("g", F.col("session_id").cast("long") % 500)
    matched = d.groupBy("g").agg(F.collect_list(F.struct("line", "col", "rule", "severity", "message")).alias("matches"))
    return report.directory_report(matched.select(F.concat(F.lit("src/g"), "g", F.lit(".ts")).alias("file_path"), F.when(F.col("g") % 9 > 0, F.lit("x")).alias("content"), "matches"))


@query(f"WITH {_SCORES}, n AS (SELECT session_id, count(*) FILTER (status <> 'resolved' AND severity = 'error') AS a, count(*) FILTER (status = 'resolved' AND severity = 'error') AS r, count(*) FILTER (has_fix) AS f FROM scored GROUP BY session_id) SELECT session_id, CASE WHEN a > 0 THEN 'Next: address the active issues above before continuing.' WHEN r > 0 THEN 'Next: clean run — keep going.' WHEN f > 0 THEN 'Next: review the suggested fixes; apply if appropriate.' ELSE 'Next: continue.' END AS next FROM n")
def next_directive(spark, sf_dir):
    n = diagnostics(spark, sf_dir).groupBy("session_id").agg(F.count_if((F.col("status") != "resolved") & (F.col("severity") == "error")).alias("a"), F.count_if((F.col("status") == "resolved") & (F.col("severity") == "error")).alias("r"), F.count_if("has_fix").alias("f"))
    return n.select("session_id", report.next_step(F.col("a"), F.col("r"), F.col("f")).alias("next"))


_PAYLOADS = """CASE event_id % 4 WHEN 0 THEN concat('{"details":{"diagnostics":[{"id":"d', CAST(user_id % 7 AS STRING), '","filePath":"a.ts","line":5,"column":2,"severity":"error","rule":"r","message":"m","hasFix":true},{"severity":"odd"}]}}') WHEN 1 THEN 'no json' WHEN 2 THEN '{"details":{}}' END"""
_NO_ID = """sha256('{"file_path":"","line":0,"col":0,"severity":"warning","rule":"","message":""}')"""
_HARVEST_SQL = f"h AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seen, concat('d', user_id % 7) AS id, 'a.ts' AS file_path, 5 AS line, 'error' AS severity, true AS has_fix FROM events WHERE event_id % 4 = 0 UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, {_NO_ID}, '', 0, 'warning', false FROM events WHERE event_id % 4 = 0)"


def _harvested(spark, sf_dir) -> DataFrame:
    return lifecycle.harvest(table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS session_id", "event_id AS seq", f"{_PAYLOADS} AS payload"))


@query(f"WITH {_HARVEST_SQL} SELECT * FROM h")
def harvest_results(spark, sf_dir):
    return _harvested(spark, sf_dir).select("session_id", "seen", "id", "file_path", "line", "severity", "has_fix")


@query(f"""WITH {_HARVEST_SQL}, o AS (SELECT session_id, id, CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN 'resolved' ELSE 'emitted' END AS status, min(seen) AS first_seen, min(seen) AS last_seen FROM h WHERE seen % 8 < 4 GROUP BY session_id, id),
n AS (SELECT session_id, id, min(seen) AS first_seen, max(seen) AS last_seen FROM h WHERE seen % 8 >= 4 GROUP BY session_id, id)
SELECT coalesce(o.session_id, n.session_id) AS session_id, coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'emitted' ELSE o.status END AS status, least(coalesce(o.first_seen, n.first_seen), coalesce(n.first_seen, o.first_seen)) AS first_seen, greatest(coalesce(o.last_seen, n.last_seen), coalesce(n.last_seen, o.last_seen)) AS last_seen FROM o FULL JOIN n ON o.session_id = n.session_id AND o.id = n.id""")
def revive_records(spark, sf_dir):
    h = _harvested(spark, sf_dir)
    old = h.filter("seen % 8 < 4").groupBy("session_id", "id").agg(F.min("seen").alias("first_seen"), F.min("seen").alias("last_seen")).withColumn("status", F.when(F.col("session_id").cast("long") % 2 == 0, "resolved").otherwise("emitted"))
    return lifecycle.revive(old, h.filter("seen % 8 >= 4"))


@query(f"WITH {CODE_SQL}, f AS (SELECT file_path, CAST(CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT) % 16 AS INTEGER) AS line, content FROM code), s AS (SELECT file_path, line, CASE WHEN line > 0 THEN regexp_replace(string_split(content, chr(10))[line], '\\s+$', '') END AS t FROM f) SELECT file_path, line, CASE WHEN t = '' THEN NULL WHEN len(t) > 120 THEN concat(t[1:119], '…') ELSE t END AS snippet FROM s")
def finding_snippets(spark, sf_dir):
    files = code(spark, sf_dir)
    findings = files.select("file_path", (F.regexp_extract("file_path", "f([0-9]+)", 1).cast("long") % 16).cast("int").alias("line"))
    return lifecycle.with_snippets(findings, files).select("file_path", "line", "snippet")


_CONFIGS = """CASE p_partkey % 4 WHEN 0 THEN 'x{' WHEN 1 THEN '{"linters":[{"name":"eslint","format":"json","extensions":[".x"]},{"name":"own","format":"generic"}]}' WHEN 2 THEN '{"overrideDefaults":true,"linters":[{"name":"ruff","format":"json","extensions":[".py"]}]}' END"""
_DEFAULT_NAMES = "unnest(['eslint', 'prettier', 'biome', 'ruff', 'black', 'clippy', 'rustfmt', 'golangci-lint', 'clang-tidy', 'rubocop', 'shellcheck', 'phpstan'])"


@query(f"SELECT * FROM (SELECT p_partkey AS project, {_DEFAULT_NAMES} AS name, 'default' AS origin, p_partkey % 4 AS k FROM part WHERE p_partkey % 4 <> 2) WHERE NOT (k = 1 AND name = 'eslint') UNION ALL SELECT p_partkey, unnest(['eslint', 'own']), 'user', 1 FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT p_partkey, 'ruff', 'user', 2 FROM part WHERE p_partkey % 4 = 2")
def config_json(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS project", f"{_CONFIGS} AS config")
    return config.configured(p).select("project", "name", "origin", (F.col("project") % 4).alias("k"))


@query("WITH c(name, ext) AS (VALUES ('tsc', '.ts'), ('tsc', '.tsx'), ('tsc', '.mts'), ('tsc', '.cts'), ('mypy', '.py'), ('cargo-check', '.rs'), ('pyright', '.py'), ('pyright', '.pyi')), " + CODE_SQL + " SELECT file_path, name FROM code JOIN c ON suffix(file_path, ext)")
def checker_applicability(spark, sf_dir):
    return config.applicable(code(spark, sf_dir), config.tools(spark, config.CHECKERS))


@query("SELECT CAST(p_partkey AS VARCHAR) AS name FROM part WHERE p_partkey % 3 = 0")
def tool_availability(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), "p_partkey")
    return config.available(p.select("name"), p.filter("p_partkey % 3 = 0").select("name"))


@query("WITH v AS (SELECT o_orderkey, CAST(o_orderkey % 13 AS INT) AS a, (o_orderkey % 80) / 10.0 AS ea FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS file_path, 'sievecast/deep-nesting' AS rule, CASE WHEN a > 10 THEN 'error' ELSE 'warning' END AS severity FROM v WHERE a > 6 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'sievecast/high-entropy', 'info' FROM v WHERE ea > 6.5")
def absolute_facts(spark, sf_dir):
    v = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS file_path", "CAST(o_orderkey % 13 AS INT) AS nesting_after", "CAST(0 AS INT) AS nesting_before", "(o_orderkey % 80) / 10.0 AS entropy_after", "0.0 AS entropy_before")
    return rules.crossing_facts(v, absolute=True)


_LINT = "CAST(CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT) % 20 AS INT)"


@query(f"WITH {_CHANGED}, l AS (SELECT file_path, before, {_LINT} AS line FROM edits) SELECT l.file_path, l.line FROM l LEFT JOIN changed c ON l.file_path = c.file_path AND l.line = c.line WHERE before = '' OR l.line = 0 OR c.line IS NOT NULL")
def lint_new(spark, sf_dir):
    e = edits(spark, sf_dir)
    return diff.new_lint(e.selectExpr("file_path", f"{_LINT} AS line"), e)


@query(f"WITH {CODE_SQL}, k AS (SELECT file_path, CAST(regexp_extract(file_path, 'f([0-9]+)', 1) AS BIGINT) AS k FROM code) SELECT file_path, concat('r', k % 5) AS rule FROM k WHERE k % 5 <> k % 4")
def file_level_filter(spark, sf_dir):
    k = F.regexp_extract("file_path", "f([0-9]+)", 1).cast("long")
    files = code(spark, sf_dir).select("file_path", k.alias("k"))
    matches = files.select("file_path", F.lit(0).alias("line"), F.concat(F.lit("r"), F.col("k") % 5).alias("rule"))
    before = files.select("file_path", F.concat(F.lit("r"), F.col("k") % 4).alias("rule"))
    return diff.new_matches(matches, edits(spark, sf_dir), before).select("file_path", "rule")


@query(f"WITH {DIAGNOSTICS_SQL} SELECT id, touched_start >= 0 AND line BETWEEN touched_start AND touched_end AS inside FROM d")
def line_in_range(spark, sf_dir):
    return diagnostics(spark, sf_dir).select("id", ((F.col("touched_start") >= 0) & text.in_range(F.col("line"), F.col("touched_start"), F.col("touched_end"))).alias("inside"))


@query(f"WITH {DIAGNOSTICS_SQL} SELECT file_path, 'biome' AS tool, line, col, severity, rule, message FROM d UNION ALL SELECT file_path, 'mypy', line, col, CASE severity WHEN 'info' THEN 'info' WHEN 'warning' THEN 'warning' ELSE 'error' END, rule, message FROM d")
def parse_dispatch(spark, sf_dir):
    biome = _output(spark, sf_dir, "biome", "json", F.to_json(F.struct(_list("line", F.col("col").alias("column"), "severity", "rule", "message").alias("issues"))))
    kind = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    mypy = _output(spark, sf_dir, "mypy", "mypy-json", F.to_json(_list(kind.alias("severity"), F.col("rule").alias("code"), "line", F.col("col").alias("column"), "message")))
    return parsers.parse(biome.unionByName(mypy)).drop("has_fix")


# Places: spans in ranges, nearest touched lines; tables that are kept up to date; registered patterns; sessions.
_SPAN = {
    "file_path": "concat('f', CAST(l_suppkey % 50 AS STRING))",
    "id": "concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING))",
    "first_line": "CAST(l_partkey * 37 % 20011 AS INT)",
    "last_line": "CAST(l_partkey * 37 % 20011 + l_linenumber % 5 AS INT)",
}
_RANGE = {"file_path": "concat('f', CAST(o_custkey % 50 AS STRING))", "first_line": "CAST(o_orderkey * 13 % 20011 AS INT)", "last_line": "CAST(o_orderkey * 13 % 20011 + o_orderkey % 9 AS INT)"}
_SESSION = {
    "session_id": "CAST(user_id % 40 AS STRING)",
    "seq": "event_id",
    "kind": "CASE event_type WHEN 'view' THEN 'turn_end' WHEN 'signup' THEN 'tool_execution_end' WHEN 'error' THEN 'session_start' ELSE 'tool_call' END",
    "tool_name": "CASE WHEN event_id % 3 = 0 THEN 'read' ELSE 'edit' END",
    "file_path": "CAST(event_id % 5 AS STRING)",
    "content": "props",
}


def _as(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


@query(f"""WITH s AS (SELECT {', '.join(_as(_SPAN))} FROM lineitem), r AS (SELECT {', '.join(_as(_RANGE))} FROM orders)
SELECT id, file_path, first_line, last_line, EXISTS (SELECT 1 FROM r WHERE r.file_path = s.file_path AND r.first_line <= s.first_line AND r.last_line >= s.last_line) AS inside FROM s""")
def span_in_ranges(spark, sf_dir):
    return asof.in_ranges(table(spark, sf_dir, "lineitem").selectExpr(*_as(_SPAN)), table(spark, sf_dir, "orders").selectExpr(*_as(_RANGE)))


@query(f"""WITH d AS (SELECT {', '.join(_as(_SPAN))} FROM lineitem), t AS (SELECT DISTINCT file_path, first_line AS line FROM (SELECT {', '.join(_as(_RANGE))} FROM orders)),
n AS (SELECT id, d.file_path, first_line, b.line AS before, a.line AS after FROM d ASOF LEFT JOIN t b ON d.file_path = b.file_path AND d.first_line >= b.line ASOF LEFT JOIN t a ON d.file_path = a.file_path AND d.first_line <= a.line)
SELECT id, file_path, first_line AS line, CAST(least(first_line - before, after - first_line) AS BIGINT) AS distance, round(CASE WHEN before IS NULL AND after IS NULL THEN 50 ELSE greatest(0, 100.0::DOUBLE * (1 - least(first_line - before, after - first_line)::DOUBLE / 50)) END, 4) AS near FROM n""")
def nearest_touched_line(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").selectExpr(*_as(_SPAN)).select("id", "file_path", F.col("first_line").alias("line"))
    touched = table(spark, sf_dir, "orders").selectExpr(*_as(_RANGE)).select("file_path", F.col("first_line").alias("line"))
    return asof.nearest_touched(d, touched).withColumn("near", F.round("near", 4))


@query("SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS seq, arg_max(event_type, event_id) AS severity FROM events GROUP BY user_id")
def change_feed(spark, sf_dir):
    """The table that a feed of all events leaves behind: five batches, one of them twice, with a base in between."""
    f = feed.ChangeFeed(shared_folder(spark, "feed"), every=2)
    e = table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS id", "event_id AS seq", "event_type AS severity")
    for number in (0, 1, 2, 2, 3, 4, 1):
        f.apply(e.filter(F.col("seq") % 5 == number), number)
    return f.current(spark)


@query(f"""WITH {_MASKED}, {_SPLIT}, cost AS (SELECT file_path, CAST(sum(CASE WHEN t NOT IN ('{{', '}}') THEN 1 + depth ELSE 0 END) AS INTEGER) AS cognitive, CAST(max(depth) AS INTEGER) AS max_nesting FROM deep GROUP BY file_path)
SELECT file_path, CAST(1 + len(list_filter({_CODE_TOKENS}, lambda t: t IN ('if', 'while', 'for', 'case', '&&', '||', '?'))) AS INTEGER) AS cyclomatic, cognitive, max_nesting FROM masked JOIN cost USING (file_path)""")
def incremental_metrics(spark, sf_dir):
    """Metrics of all files, half of them kept from a run before."""
    store = incremental.MetricStore(shared_folder(spark, "metrics"))
    files = code(spark, sf_dir)
    store.run(files.filter("pmod(hash(file_path), 2) = 0"), 0)
    return store.run(files, 1).select("file_path", "cyclomatic", "cognitive", "max_nesting")


_WATCHED = ("obj", "innerHTML", "outerHTML", "catch", "while", "debugger", "console", "password", "api_key", "exec")


@query(f"WITH {_MASKED}, {_MASKED_LINES}, f AS (SELECT file_path, line, w, len(regexp_extract_all(x, '\\b' || w || '\\b')) AS n FROM lines, (VALUES " + ", ".join(f"('{w}')" for w in _WATCHED) + ") AS v(w)) SELECT file_path, line, 'sievecast/no-' || w AS rule, CAST(n AS BIGINT) AS n FROM f WHERE n > 0")
def registered_patterns(spark, sf_dir):
    """Ten own patterns over all files in one scan."""
    own = registry.Registry()
    for w in _WATCHED:
        own.add_pattern(f"no-{w}", rf"\b{w}\b", f"{w} is not wanted")
    return own.pattern_matches(code(spark, sf_dir)).groupBy("file_path", "line", "rule").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT {', '.join(_as(_SESSION))} FROM events), k AS (SELECT *, kind = 'tool_call' AND tool_name = 'edit' AS edit FROM e),
c AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('tool_execution_end', 'session_start') THEN 1 ELSE 0 END) OVER w, 0) AS part FROM k WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, bool_or(edit) OVER (PARTITION BY session_id, part) AS changing FROM c),
s AS (SELECT *, kind = 'session_start' AS reset, kind = 'tool_execution_end' AND NOT changing AS idle FROM p),
g AS (SELECT *, coalesce(sum(CASE WHEN kind = 'turn_end' OR reset OR idle THEN 1 ELSE 0 END) OVER w, 0) AS span, coalesce(sum(CASE WHEN kind = 'turn_end' OR reset THEN 1 ELSE 0 END) OVER w, 0) AS turn_span, coalesce(sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER w, 0) AS life FROM s WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'turn_end' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS turn FROM g)
SELECT session_id, min(seq) AS seq, arg_min(turn, seq) AS turn, 'snapshot' AS action, file_path, arg_min(content, seq) AS content FROM t WHERE edit GROUP BY session_id, span, file_path
UNION ALL SELECT t.session_id, t.seq, t.turn, 'stale', d.file_path, NULL FROM t JOIN (SELECT DISTINCT session_id, span, file_path FROM t WHERE edit) d ON t.session_id = d.session_id AND t.span = d.span WHERE idle
UNION ALL SELECT t.session_id, t.seq, t.turn, 'lint', d.file_path, NULL FROM t JOIN (SELECT DISTINCT session_id, turn_span, file_path FROM t WHERE edit) d ON t.session_id = d.session_id AND t.turn_span = d.turn_span WHERE kind = 'turn_end'""")
def session_machine(spark, sf_dir):
    """Snapshots, stale ones and lint queues of all sessions."""
    e = table(spark, sf_dir, "events").selectExpr(*_as(_SESSION), "CAST(NULL AS STRING) AS command", "CAST(NULL AS array<struct<file_path:string,id:string>>) AS found")
    return session.session_actions(e).select("session_id", "seq", "turn", "action", "file_path", "content")
