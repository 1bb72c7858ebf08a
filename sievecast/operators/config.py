"""Tool tables and their configuration: overrides, overlays, applicability, fixer chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Linter, format, extensions.
LINTERS = (
    ("eslint", "eslint", (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")),
    ("prettier", "generic", (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".json", ".css", ".scss", ".less", ".html", ".md", ".yaml", ".yml")),
    ("biome", "json", (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".json", ".jsonc")),
    ("ruff", "json", (".py",)),
    ("black", "generic", (".py",)),
    ("clippy", "json", (".rs",)),
    ("rustfmt", "generic", (".rs",)),
    ("golangci-lint", "json", (".go",)),
    ("clang-tidy", "json", (".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx")),
    ("rubocop", "json", (".rb",)),
    ("shellcheck", "json", (".sh", ".bash", ".zsh")),
    ("phpstan", "json", (".php",)),
)
#: Checker, format, extensions.
CHECKERS = (("tsc", "tsc", (".ts", ".tsx", ".mts", ".cts")), ("mypy", "mypy-json", (".py",)), ("cargo-check", "cargo-json", (".rs",)), ("pyright", "pyright-json", (".py", ".pyi")))
FIXERS = ("eslint", "prettier", "biome")
_DDL = "name string, format string, extensions array<string>"


def tools(spark, rows=LINTERS) -> DataFrame:
    return spark.createDataFrame([(n, f, list(e)) for n, f, e in rows], _DDL)


def merge(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """User entries override defaults of the same name; new ones are appended."""
    return defaults.join(user, "name", "left_anti").unionByName(user)


_CONFIG = "struct<linters:array<struct<name:string,format:string,extensions:array<string>>>,overrideDefaults:boolean>"


def configured(projects: DataFrame, rows=LINTERS) -> DataFrame:
    """``project, name, format, extensions, origin``: the tools of each project by its configuration (project, config JSON).

    ``linters`` override defaults of the same name and add others; with ``overrideDefaults`` they stand
    alone. No or broken JSON leaves the defaults. The defaults are a few fixed rows, so each project is
    made up in its row.
    """
    tool = lambda n, f, e, origin: F.struct(n.alias("name"), f.alias("format"), e.alias("extensions"), F.lit(origin).alias("origin"))
    defaults = F.array(*[tool(F.lit(n), F.lit(f), F.array(*map(F.lit, e)), "default") for n, f, e in rows])
    parsed = projects.select("project", F.from_json("config", _CONFIG).alias("_c"))
    user = F.coalesce(F.transform("_c.linters", lambda t: tool(t["name"], t["format"], F.coalesce(t["extensions"], F.array().cast("array<string>")), "user")), F.array())
    p = parsed.select("project", F.coalesce("_c.overrideDefaults", F.lit(False)).alias("_alone"), user.alias("_user"))
    kept = F.filter(defaults, lambda d: ~F.exists("_user", lambda u: u["name"] == d["name"]))
    return p.select("project", F.inline(F.when(F.col("_alone"), F.col("_user")).otherwise(F.concat(kept, F.col("_user")))))


def overlay(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """Field by field: the user's value where there is one."""
    fields = [c for c in defaults.columns if c != "name"]
    u = user.select("name", *[F.col(c).alias(f"_{c}") for c in fields])
    return defaults.join(u, "name", "left").select("name", *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def applicable(files: DataFrame, tool_table: DataFrame) -> DataFrame:
    """``file_path, name``: each tool that takes a file, by the end of its path; no extensions means all.

    An equi-join: a path is looked up by each of its ends that begins with a dot, a tool by each of its extensions.
    """
    parts = F.split(F.substring_index("file_path", "/", -1), r"\.")
    end = lambda k: F.concat(F.lit("."), F.array_join(F.slice(parts, k + 1, F.size(parts)), "."))
    ends = files.select("file_path", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), end))).alias("_end"))
    by_end = tool_table.filter(F.size("extensions") > 0).select("name", F.explode(F.array_distinct("extensions")).alias("_end"))
    # a scalar subquery: one list, run with the query and not while its plan is made
    every = tool_table.filter(F.size("extensions") == 0).agg(F.collect_list("name").alias("_names"))
    found = ends.join(by_end, "_end").select("file_path", "name").distinct()
    return found.unionByName(files.withColumn("_names", every.scalar()).select("file_path", F.explode("_names").alias("name")))


def available(tool_table: DataFrame, installed: DataFrame) -> DataFrame:
    return tool_table.join(installed, "name", "left_semi")


def fix_candidates(records: DataFrame) -> DataFrame:
    return records.filter((F.col("status") != "resolved") & F.col("has_fix")).select("file_path").distinct()


def chain_fixers(outputs: DataFrame) -> DataFrame:
    """``file_path, content`` after ordered fixer runs (file_path, step, before, after, ok): the last that worked; failures keep the text."""
    g = outputs.groupBy("file_path").agg(F.max_by("after", F.when(F.col("ok"), F.col("step"))).alias("_after"), F.min_by("before", "step").alias("_before"), F.count_if("ok").alias("_ok"))
    return g.select("file_path", F.when(F.col("_ok") > 0, F.col("_after")).otherwise(F.col("_before")).alias("content"))
