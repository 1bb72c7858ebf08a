"""Joins by place: is a span in one of many ranges, and how near is a line to one that was touched. As-of joins in two levels, without a join of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import proximity

#: Lines of a block: a file's rows are worked on block by block, so one file is never one task's alone.
BLOCK = 4096


def carried_max(rows: DataFrame, by: list[str], at: Column, value: Column, name: str, first: Column, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``name``: the largest ``value`` of the rows of their group (``by``) at or before their place.

    Values are null where a row has none to give. Of rows at one place, those with the smaller ``first`` come
    before. Rows are ordered within blocks of places; what the blocks before hold is one number each.
    """
    own = rows.withColumns({"_at": at.cast("long"), "_value": value, "_first": first})
    own = own.withColumn("_block", F.floor(F.col("_at") / block))
    blocks = own.groupBy(*by, "_block").agg(F.max("_value").alias("_most"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.max("_most").over(earlier)).drop("_most")
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_block"]]
    joined = own.alias("r").join(blocks.alias("b"), keys).select("r.*", "b._before")
    within = Window.partitionBy(*by, "_block").orderBy("_at", "_first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn(name, F.greatest("_before", F.max("_value").over(within))).drop("_at", "_value", "_first", "_block", "_before")


def in_ranges(spans: DataFrame, ranges: DataFrame, by: str = "file_path", block: int = BLOCK) -> DataFrame:
    """``spans`` (by, first_line, last_line, ...) with ``inside``: whether one range (by, first_line, last_line) of the same file holds all of it.

    One does if, of the ranges that begin at or before it, the furthest end reaches its last line; ranges that only
    hold it together do not. The rows of both are sorted by place, whatever the number of ranges. Null lines are in
    none; a span that ends before it begins is in what holds both its lines.
    """
    columns = spans.columns
    probe = spans.select(F.struct(*columns).alias("_row"), by, F.col("first_line").alias("_a"), F.lit(None).cast("long").alias("_end"), F.lit(1).alias("_kind"))
    range_ = ranges.filter("first_line IS NOT NULL AND last_line IS NOT NULL").groupBy(by, "first_line").agg(F.max("last_line").alias("last_line"))
    held = range_.select(F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), by, F.col("first_line").alias("_a"), F.col("last_line").cast("long").alias("_end"), F.lit(0).alias("_kind"))
    out = carried_max(probe.unionByName(held), [by], F.col("_a"), F.col("_end"), "_reach", F.col("_kind"), block).filter("_kind = 1")
    a, b = F.col("_row.first_line"), F.col("_row.last_line")
    inside = a.isNotNull() & b.isNotNull() & (F.col("_reach") >= b)
    return out.select("_row.*", F.coalesce(inside, F.lit(False)).alias("inside"))


def nearest_touched(diagnostics: DataFrame, touched: DataFrame, by: str = "file_path", block: int = BLOCK) -> DataFrame:
    """``diagnostics`` (by, line, ...) with ``distance`` to the nearest touched line (by, line) of the file, and the proximity ``near`` by it: null and 50 where none was touched or the line is null.

    The touched line before is the largest so far in order of lines, the one behind the same from the other end.
    """
    columns = diagnostics.columns
    probe = diagnostics.select(F.struct(*columns).alias("_row"), by, F.col("line").cast("long").alias("_a"), F.lit(None).cast("long").alias("_touched"))
    lines = touched.filter("line IS NOT NULL").select(by, F.col("line").cast("long").alias("_a")).distinct()
    points = lines.select(F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), by, "_a", F.col("_a").alias("_touched"))
    both = probe.unionByName(points).withColumn("_kind", F.when(F.col("_touched").isNull(), 1).otherwise(0))
    out = carried_max(both, [by], F.col("_a"), F.col("_touched"), "_lower", F.col("_kind"), block)
    out = carried_max(out, [by], -F.col("_a"), -F.col("_touched"), "_upper", F.col("_kind"), block).filter("_kind = 1")
    distance = F.least(F.col("_a") - F.col("_lower"), -F.col("_upper") - F.col("_a"))
    out = out.withColumn("_distance", distance)
    near = proximity(F.col("_distance"), F.when(F.col("_distance").isNull(), -1).otherwise(0), F.lit(0))
    return out.select("_row.*", F.col("_distance").alias("distance"), near.alias("near"))
