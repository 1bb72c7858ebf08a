"""File sources and the guards before analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .directory import SourceFiles

#: Folders that hold no sources of one's own, and extensions of source files.
SKIPPED_FOLDERS = ("node_modules", ".git", ".pi", ".next", ".nuxt", ".cache", "dist", "build", "coverage", ".vscode", ".idea")
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java", "cpp", "cc", "cxx", "c", "h", "hpp", "rb", "php", "cs", "swift", "kt", "scala", "sh", "bash", "zsh", "css", "scss", "less", "json", "jsonc", "yaml", "yml", "toml", "md", "mdx", "html", "vue", "svelte", "lean")
#: Lock files.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "Cargo.lock", "Gemfile.lock", "composer.lock", "poetry.lock")
SYNTAX_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
LONGEST, SNIFFED = 256_000, 8_192


def _ends(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(extensions) + r")\z")


def is_source(path: Column) -> Column:
    folders = "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS)
    return ~path.rlike(f"(^|/)({folders})/") & _ends(path, EXTENSIONS)


def skip_by_path(path: Column) -> Column:
    """Lock files, minified files and source maps."""
    locks = "|".join(x.replace(".", r"\.") for x in LOCK_FILES)
    return path.rlike(rf"(^|/)({locks})\z") | path.rlike(r"\.min\.(js|css)\z") | path.endswith(".map")


def skip_by_content(content: Column) -> Column:
    """Texts over the length limit (code points), or with a NUL near their start."""
    return (F.length(content) > LONGEST) | (F.instr(F.substring(content, 1, SNIFFED), "\0") > 0)


def has_syntax_rules(path: Column) -> Column:
    return _ends(path, SYNTAX_EXTENSIONS)


def guarded(files: DataFrame) -> DataFrame:
    """Files to analyse. The path is looked at first, so a source can leave contents unread."""
    return files.filter(~skip_by_path(F.col("file_path"))).filter(~skip_by_content(F.col("content")))


def read_directory(spark: SparkSession, path: str, most: int | None = None, longest: int = 4 * LONGEST) -> DataFrame:
    """``file_path, content`` of the source files below a folder; the first ``most`` by path if given. Bytes that aren't UTF-8 are replaced.

    Paths are listed first, folder by folder, and the listing stops at ``most``; files of more than ``longest``
    bytes (four a code point of the guard's limit) are left out. Then tasks read the chosen files' contents and no
    others, and nothing is shuffled. A file that is listed but cannot be read has a null content, which a summary
    counts as a warning; a folder that is not there has no files.
    """
    spark.dataSource.register(SourceFiles)
    pattern = "(?i)\\.(" + "|".join(EXTENSIONS) + ")$"
    without = "(^|/)(" + "|".join(x.replace(".", "\\.") for x in LOCK_FILES) + ")$|\\.min\\.(js|css)$|\\.map$"
    reader = spark.read.format("source_files").option("pattern", pattern).option("without", without).option("skippedFolders", ",".join(SKIPPED_FOLDERS)).option("longest", str(longest)).option("path", path)
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader if most is None else reader.option("most", str(most))).load()
