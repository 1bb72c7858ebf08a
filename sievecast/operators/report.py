"""Reports: grouped top-k rankings, counts, directory summaries, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import SEVERITIES

PER_FILE, RESOLVED, PER_SEVERITY, PER_FILE_SUMMARY = 20, 10, 5, 10
#: What ends every order, so that rows of one id and score stand in one order too. What ties in all of it reads the same.
TIES = ("id", "severity", "rule", "message", "file_path", "snippet", "fix")


def _ties(df: DataFrame) -> list[str]:
    return [c for c in TIES if c in df.columns]


def count_severities(diagnostics: DataFrame, *by: str) -> DataFrame:
    """How many of each severity, in exact case; others count nowhere."""
    return diagnostics.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])


def top_by_file(scored: DataFrame, k: int = PER_FILE) -> DataFrame:
    """The k best of each file by score, then line, then TIES, with ``rank``, the file's best score and how many more there are."""
    by_file = Window.partitionBy("file_path")
    ranked = scored.withColumn("rank", F.row_number().over(by_file.orderBy(F.desc("score"), "line", *_ties(scored)))).filter(F.col("rank") <= k)
    totals = scored.groupBy("file_path").agg(F.max("score").alias("file_score"), F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return ranked.join(totals, "file_path")


def top_resolved(records: DataFrame, k: int = RESOLVED, by: str = "session_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("last_seen"), *_ties(records))
    return records.filter("status = 'resolved'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def widget(issues: DataFrame, k: int = PER_SEVERITY) -> DataFrame:
    """k issues of each severity, and how many more it has."""
    ranked = issues.withColumn("rank", F.row_number().over(Window.partitionBy("severity").orderBy("file_path", "line", *_ties(issues)))).filter(F.col("rank") <= k)
    totals = issues.groupBy("severity").agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return ranked.join(totals, "severity")


def overall_status(diagnostics: DataFrame, *by: str) -> DataFrame:
    """major with any error, minor with anything else, clean with nothing (a null severity, as from an outer join)."""
    worst = F.when(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)), "major").when(F.count("severity") > 0, "minor").otherwise("clean")
    return diagnostics.groupBy(*by).agg(worst.alias("status"))


def directory_summary(matched: DataFrame) -> DataFrame:
    """``file_path, highest, n_error, n_warning, n_info, n_hint, n_issues`` of files with their ``matches`` in an array; clean without a match. A file that can't be read (null content) is a warning. Counted in the row: no shuffle."""
    count = lambda severity: F.size(F.filter("matches", lambda m: m["severity"] == severity)).cast("long")
    own = {f"n_{s}": count(s) for s in SEVERITIES} | {"n_issues": F.size("matches").cast("long")}
    s = matched.select("file_path", F.col("content").isNull().alias("_error"), *[c.alias(n) for n, c in own.items()])
    highest = F.when(F.col("n_error") > 0, "error").when((F.col("n_warning") > 0) | F.col("_error"), "warning").when(F.col("n_info") + F.col("n_hint") > 0, "info").otherwise("clean")
    return s.select("file_path", highest.alias("highest"), *own)


def header(diagnostics: DataFrame, *by: str) -> DataFrame:
    """A line with the total, the severities that occur in their order, and what was resolved."""
    active = F.col("status") != "resolved"
    counts = diagnostics.groupBy(*by).agg(F.count_if(active).alias("n"), *[F.count_if(active & (F.col("severity") == s)).alias(s) for s in SEVERITIES], F.count_if(~active).alias("resolved"))
    parts = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in (*SEVERITIES, "resolved")]
    return counts.select(*by, F.concat(F.lit("Active: "), F.col("n").cast("string"), F.when(F.coalesce(*parts).isNotNull(), F.concat(F.lit(" ("), F.concat_ws(", ", *parts), F.lit(")"))).otherwise("")).alias("header"))


def file_sections(scored: DataFrame, k: int = PER_FILE) -> DataFrame:
    """A Markdown section for each file: its k best diagnostics, and how many more."""
    line = F.concat(F.lit("- "), F.col("severity"), F.when(F.col("line") > 0, F.concat(F.lit(" L"), F.col("line").cast("string"))).otherwise(""), F.lit(": "), F.col("message"), F.lit(" ("), F.col("rule"), F.lit(")"))
    top = top_by_file(scored, k).withColumn("_line", line)
    s = top.groupBy("file_path", "file_score", "more").agg(F.array_sort(F.collect_list(F.struct("rank", "_line"))).alias("rows"))
    tail = F.when(F.col("more") > 0, F.concat(F.lit("\n+"), F.col("more").cast("string"), F.lit(" more"))).otherwise("")
    return s.select("file_path", "file_score", F.concat(F.lit("### "), F.col("file_path"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["_line"]), "\n"), tail).alias("section"))


def next_step(active, resolved, suggested):
    """The closing line of a report, of three counts as columns. The sentences are fixed values."""
    return F.when(active > 0, "Next: address the active issues above before continuing.").when(resolved > 0, "Next: clean run — keep going.").when(suggested > 0, "Next: review the suggested fixes; apply if appropriate.").otherwise("Next: continue.")


#: How a report names severities.
LABELS = (("error", "ERROR"), ("warning", "WARN"), ("info", "INFO"), ("hint", "HINT"))


def _line(text: Column) -> Column:
    """A line of a report where there is a text, with the newline before it."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.concat(F.lit("\n"), text)).otherwise("")


def _more(n: Column, most: int, tail: str) -> Column:
    return F.when(n > most, F.concat(F.lit("\n- …and "), (n - most).cast("string"), F.lit(tail))).otherwise("")


def issue_sections(active: DataFrame, hidden: DataFrame | None = None, by: str = "session_id", k: int = PER_FILE) -> DataFrame:
    """``by, file_path, best, section``: of each file its k best active issues with snippet and fix, by score, line and TIES; how many more; and how many older ones are ``hidden`` (by, file_path, n_preexisting)."""
    label = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS for x in pair]), F.col("severity"))
    where = F.when(F.col("line") > 0, F.concat(F.lit("line "), F.col("line").cast("string"))).otherwise("whole file")
    entry = F.concat(F.lit("\n- ["), label, F.lit("] "), where, F.lit(" — "), F.col("message"), F.lit(" ["), F.col("rule"), F.lit("]"), _line(F.concat(F.lit("    "), F.col("snippet"))), _line(F.concat(F.lit("    Fix: "), F.col("fix"))))
    own = Window.partitionBy(by, "file_path")
    ranked = active.withColumns({"_rank": F.row_number().over(own.orderBy(F.desc("score"), "line", *_ties(active))), "_n": F.count("*").over(own), "_entry": entry}).filter(F.col("_rank") <= k)
    s = ranked.groupBy(by, "file_path").agg(F.max("_n").alias("n"), F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("_rank", "_entry"))).alias("entries"))
    s = s.withColumn("n_hidden", F.lit(0)) if hidden is None else s.join(hidden.select(by, "file_path", F.col("n_preexisting").alias("n_hidden")), [by, "file_path"], "left")
    older = F.when(F.col("n_hidden") > 0, F.concat(F.lit("\n- pre-existing issues hidden: "), F.col("n_hidden").cast("string"), F.lit(" (not blocking)"))).otherwise("")
    head = F.concat(F.lit("\n\n"), F.col("file_path"), F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " issue)").otherwise(" issues)"))
    return s.select(by, "file_path", "best", F.concat(head, older, F.array_join(F.transform("entries", lambda e: e["_entry"]), ""), _more(F.col("n"), k, " more in this file")).alias("section"))


def diagnostic_report(records: DataFrame, suggested: DataFrame | None = None, hidden: DataFrame | None = None, by: str = "session_id") -> DataFrame:
    """``by, report``: one text for each session with anything to say.

    Records have by, id, file_path, line, severity, message, rule, status, score, last_seen, snippet, fix;
    suggested fixes (by, file_path, fixers array). A header, a section a file by its best score, what was
    resolved, the suggested fixes, and what to do next. Everything is ranked and cut before it is
    gathered, so a session's text grows with its files alone.
    """
    resolved = F.col("status") == "resolved"
    counts = records.groupBy(by).agg(F.count_if(~resolved).alias("n"), F.count_if(resolved).alias("r"), *[F.count_if(~resolved & (F.col("severity") == s)).alias(s) for s in SEVERITIES])
    files = issue_sections(records.filter(~resolved), hidden, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("order"), "file_path", "section"))).alias("files"))
    where = F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise("")
    gone = top_resolved(records, by=by).select(by, "rank", F.concat(F.lit("\n- "), "file_path", where, F.lit(" — "), "message", F.lit(" ["), "rule", F.lit("]")).alias("entry"))
    gone = gone.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("gone"))
    out = counts.join(files, by, "left").join(gone, by, "left")
    if suggested is None:
        out = out.withColumns({"fixes": F.lit(None).cast("array<struct<file_path:string,text:string>>")})
    else:
        how = F.when(F.size("fixers") > 0, F.array_join("fixers", "+")).otherwise("autofix")
        fixes = suggested.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("file_path", F.concat("file_path", F.lit(" ("), how, F.lit(")")).alias("text")))).alias("fixes"))
        out = out.join(fixes, by, "full").fillna(0, ["n", "r", *SEVERITIES])
    parts = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in SEVERITIES])
    head = F.concat(F.lit("Active: "), F.col("n").cast("string"), F.when(F.col("n") > 0, F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(""), F.lit(". Resolved: "), F.col("r").cast("string"), F.lit("."))
    joined = lambda column, field: F.coalesce(F.array_join(F.transform(column, lambda x: x[field]), ""), F.lit(""))
    solved = F.when(F.col("r") > 0, F.concat(F.lit("\n\nResolved this cycle ("), F.col("r").cast("string"), F.lit("):"), joined("gone", "entry"), _more(F.col("r"), RESOLVED, " more"))).otherwise("")
    offered = F.when(F.size("fixes") > 0, F.concat(F.lit("\n\nSuggested fixes: "), F.array_join(F.transform("fixes", lambda x: x["text"]), ", "), F.lit("."))).otherwise("")
    n_fixes = F.greatest(F.coalesce(F.size("fixes"), F.lit(0)), F.lit(0))
    text = F.concat(head, joined("files", "section"), solved, offered, F.lit("\n\n"), next_step(F.col("n"), F.col("r"), n_fixes))
    return out.filter((F.col("n") > 0) | (F.col("r") > 0) | (n_fixes > 0)).select(by, text.alias("report"))


def directory_report(matched: DataFrame, most: int = PER_FILE_SUMMARY) -> DataFrame:
    """``label, file_path, entry``: what a report of a directory says of each file with ``matches``, under Errors, Warnings, Info or Clean. A file shows its first ``most`` issues by line, column and rule, and how many more. A row a file, so a directory may be of any size."""
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["line"].alias("line"), m["col"].alias("col"), m["rule"].alias("rule"), m["severity"].alias("severity"), m["message"].alias("message"))))
    has = lambda severity: F.exists("matches", lambda m: m["severity"] == severity)
    unread, n = F.col("content").isNull(), F.size("matches")
    label = F.when(~unread & has("error"), "Errors").when(unread | has("warning"), "Warnings").when(n > 0, "Info").otherwise("Clean")
    name = F.concat(F.lit("- `"), F.col("file_path"), F.lit("`"))
    line = lambda m: F.concat(F.lit("\n    ["), F.upper(m["severity"]), F.lit("] "), m["message"], F.lit(" ["), m["rule"], F.lit("]"), F.when(m["line"] > 0, F.concat(F.lit(":"), m["line"].cast("string"))).otherwise(""))
    shown = F.array_join(F.transform(F.slice(ordered, 1, most), line), "")
    more = F.when(n > most, F.concat(F.lit("\n    ...and "), (n - most).cast("string"), F.lit(" more"))).otherwise("")
    entry = F.when(unread, F.concat(name, F.lit(" — Cannot read file"))).when(n == 0, name).otherwise(F.concat(name, F.lit(" ("), n.cast("string"), F.lit(" issue(s))"), shown, more))
    return matched.select(label.alias("label"), "file_path", entry.alias("entry"))
