"""What an edit changed, and which matches are new by it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType


#: Changed lines are kept as bits of blocks of 2 ** _BLOCK lines.
_BLOCK = 6
_BITS = StructType().add("block", IntegerType()).add("bits", LongType())


def _changed(old: str | None, new: str | None) -> list[int] | None:
    """Numbers of the lines whose exact text is nowhere in ``old``; for a new file (null or empty), of all lines that aren't empty. A moved line is no change; a null ``new`` has no lines.

    One hash set a file, so its cost grows with the lines. Column functions look a value up in an array or
    map by going through it, and a join would shuffle every line of both versions.
    """
    if new is None:
        return None
    known = set(old.split("\n")) if old else {""}
    return [k for k, x in enumerate(new.split("\n"), 1) if x not in known]


@F.pandas_udf(ArrayType(IntegerType()))
def changed_line_numbers(before: pd.Series, after: pd.Series) -> pd.Series:
    """:func:`_changed` of each row."""
    return pd.Series([_changed(x, y) for x, y in zip(before, after, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(_BITS))
def changed_line_bits(before: pd.Series, after: pd.Series) -> pd.Series:
    """:func:`_changed` of each row, 64 lines to a number: line k is bit k % 64 of block k / 64."""

    def one(old: str | None, new: str | None) -> list[dict] | None:
        blocks: dict[int, int] = {}
        for k in _changed(old, new) or ():
            blocks[k >> _BLOCK] = blocks.get(k >> _BLOCK, 0) | 1 << (k & 63)
        return [{"block": k, "bits": v - (v >> 63 << 64)} for k, v in blocks.items()]

    return pd.Series([one(x, y) for x, y in zip(before, after, strict=True)], dtype=object)


def changed_lines(edits: DataFrame) -> DataFrame:
    """``file_path, line`` of rows (file_path, before, after)."""
    return edits.select("file_path", F.explode(changed_line_numbers(F.col("before"), F.col("after"))).alias("line"))


def changed_blocks(edits: DataFrame) -> DataFrame:
    """``_file, _block, _bits``: the changed lines of each edit, a row for 64 lines. What rows that texts are made of hold tells Spark nothing of how many come out, so the hint keeps them from being broadcast."""
    return edits.select(F.col("file_path").alias("_file"), F.inline(changed_line_bits(F.col("before"), F.col("after")))).withColumnsRenamed({"block": "_block", "bits": "_bits"}).hint("merge")


def _block_of_line() -> Column:
    return F.shiftright("line", _BLOCK)


def _bit_of_line() -> Column:
    return F.expr("(shiftright(_bits, CAST(line & 63 AS INT)) & 1) = 1")


def _is_changed() -> Column:
    """Whether a row's line is one of a row of :func:`changed_blocks`."""
    return (F.col("file_path") == F.col("_file")) & (_block_of_line() == F.col("_block")) & _bit_of_line()


def new_matches(matches: DataFrame, edits: DataFrame, before: DataFrame) -> DataFrame:
    """Matches that the edit made: on a changed line, or for a whole file (line 0) by a rule that did not fire before. One join of the file with both, so that matches are made once."""
    lines = changed_blocks(edits).groupBy("_file", "_block").agg(F.bit_or("_bits").alias("_bits")).withColumn("_fired", F.lit(""))
    fired = before.select(F.col("file_path").alias("_file"), F.lit(-1).alias("_block"), F.lit(0).cast("long").alias("_bits"), F.col("rule").alias("_fired")).distinct()
    whole = F.col("line") == 0
    on = (F.col("file_path") == F.col("_file")) & (F.when(whole, -1).otherwise(_block_of_line()) == F.col("_block")) & (F.when(whole, F.col("rule")).otherwise("") == F.col("_fired"))
    marked = matches.join(lines.unionByName(fired).hint("merge"), on, "left")
    return marked.filter(F.when(whole, F.col("_file").isNull()).otherwise((F.col("line") > 0) & _bit_of_line())).select(*matches.columns)


def preexisting_counts(matches: DataFrame, edits: DataFrame) -> DataFrame:
    """``file_path, n_preexisting``: matches with a line that the edit did not change."""
    old = matches.filter("line > 0").join(changed_blocks(edits), _is_changed(), "left_anti")
    return old.groupBy("file_path").agg(F.count("*").alias("n_preexisting"))


def new_lint(diagnostics: DataFrame, edits: DataFrame) -> DataFrame:
    """Lint results of an edit: all of a new file or one without an edit, all without a line, else those on changed lines."""
    edited = edits.filter(F.coalesce("before", F.lit("")) != "")
    files = edited.select(F.col("file_path").alias("_edited")).distinct().hint("merge")
    lines = changed_blocks(edits).groupBy("_file", "_block").agg(F.bit_or("_bits").alias("_bits")).hint("merge")
    marked = diagnostics.join(files, F.col("file_path") == F.col("_edited"), "left")
    marked = marked.join(lines, _is_changed(), "left")
    kept = F.col("_edited").isNull() | (F.coalesce("line", F.lit(0)) == 0) | F.col("_file").isNotNull()
    return marked.filter(kept).select(*diagnostics.columns)


def line_range(edits: DataFrame) -> DataFrame:
    return changed_lines(edits).groupBy("file_path").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
