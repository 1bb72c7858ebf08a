"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, word_count

#: (weight at time 0, weight at time 1) of the sources in code-point order, repeating. Their integrals are 3, 1, 2.
SCHEDULE = ((4.0, 2.0), (1.0, 1.0), (1.0, 3.0))


def source_targets(sizes: DataFrame, schedule: Sequence[tuple[float, float]], share: float, most: float) -> DataFrame:
    """``(source, source_size)`` -> also ``w0, w1, target``.

    A source's weight is its schedule's integral over [0, 1]. Targets share ``share`` of all words by
    weight; what exceeds ``most`` times a source's words is shared again among the others. That fixed
    point has a closed form: sources fill up in order of ``most * size / weight``, and the first that
    does not sets the level of the rest. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    knots = F.array(*[F.struct(F.lit(a).alias("w0"), F.lit(b).alias("w1")) for a, b in schedule])
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("knot", knots[(F.col("rank") - 1) % len(schedule)])
    s = s.select("source", "source_size", "rank", "knot.w0", "knot.w1", ((F.col("knot.w0") + F.col("knot.w1")) / 2).alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    filling = Window.orderBy((F.col("cap") / F.col("w")), "rank")
    s = s.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)),
            "all": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    s = s.withColumn("level", (F.col("all") * F.lit(float(share)) - F.col("full")) / F.col("open"))
    first = F.min_by(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level")), F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("cap") / F.col("w")))
    s = s.withColumn("level", first.over(Window.partitionBy()))
    return s.select("source", "source_size", "w0", "w1", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _time(share: Column, w0: Column, w1: Column) -> Column:
    """The time at which a linear schedule from w0 to w1 has spent ``share`` of its integral: the root of the integrated weight."""
    slope = (w1 - w0) / (w0 + w1)
    return F.when(slope == 0, share).otherwise((F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope))


def _named(source: Column) -> Column:
    """A source as a key that is never null, so that windows and joins on it share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


_OWN = ("mix_size", "mix_source_size", "mix_target", "mix_positions")


def _mixed(docs: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, share: float = 1.5, most: float = 2.0, bucket_digits: int = 3) -> DataFrame:
    """The columns of ``docs`` as c0, c1 ... plus the mix's own."""
    source = F.col("source")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    d = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], word_count("text").alias("mix_size"), key.alias("key"), source.alias("source"), _named(source).alias("named"))
    d = d.withColumn("bucket", F.substring("key", 1, bucket_digits))
    buckets = d.groupBy("named", "bucket").agg(F.min("source").alias("source"), F.sum("mix_size").alias("words"))
    before = Window.partitionBy("named").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), schedule, share, most)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    targets = targets.withColumn("named", _named(F.col("source"))).drop("source")
    buckets = buckets.drop("source").join(targets, "named").select(F.col("named").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "w0", "w1", "target")
    inside = Window.partitionBy("named", "bucket").orderBy("key", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    d = d.join(buckets, (d["named"] == buckets["s"]) & (d["bucket"] == buckets["b"]))
    offset = F.col("before") + F.col("inside")
    copies = [F.when((offset + p * F.col("source_size")) * 2 + F.col("mix_size") < F.col("target") * 2, _time((offset + p * F.col("source_size")) / F.col("target"), F.col("w0"), F.col("w1"))) for p in range(int(most))]
    return d.withColumns({"mix_positions": F.array_compact(F.array(*copies)), "mix_source_size": F.col("source_size"), "mix_target": F.col("target")})


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The columns of ``docs`` plus ``mix_size, mix_source_size, mix_target, mix_positions``.

    ``parameters``: ``schedule`` (start and end weights of the sources in order, repeating), ``share`` of all
    words that the mix takes, ``most`` times that it takes a document, ``bucket_digits`` of the hash.

    Each source's documents stand in the order of ``md5`` of their id; the mix walks that stream of
    words, from its start again after its end, up to the source's target. ``mix_positions`` holds the
    training time in [0, 1] of every time a document is taken: the inverse, at the document's offset,
    of the source's cumulative demand. A document is taken if its middle lies before the target, so
    a source misses its target by half a document at most, and none is taken over ``most`` = 2 times.

    Offsets are prefix sums in two levels: words by (source, leading hash digits), whose running
    sums are at most ``16 ** bucket_digits`` rows a source, then within a bucket, so a source with a
    third of all rows is spread over thousands of keys. Texts are shuffled once, by these keys.

    Null or empty texts have size 0: they add nothing, and are taken as often as their place says.
    Null sources are one source, last in order; a null id sorts by the text, or as the empty text. Rows
    that repeat count once each, ties in the hash stand by size. An empty table gives an empty one. Existing
    columns of the four names are replaced; all others keep their names and values.
    """
    return _mixed(docs, **parameters).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in _OWN], *_OWN)


def training_order(docs: DataFrame, **parameters) -> DataFrame:
    """One row of ``docs`` for every time the mix takes it, range-sorted by training position; columns keep their names and values."""
    taken = _mixed(docs, **parameters).withColumn("position", F.explode("mix_positions"))
    return taken.sort("position", f"c{docs.columns.index('doc_id')}").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_positions")).alias("taken"), F.get("mix_positions", F.lit(0)).alias("first_position"))
    return mixed.sort(F.col("first_position").asc_nulls_last(), "doc_id")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END AS w0,
             CASE (rank - 1) % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS w1, source_size * 2.0::DOUBLE AS cap FROM s),
c AS (SELECT *, (w0 + w1) / 2 AS w FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             CAST(sum(source_size) OVER () AS BIGINT) AS everything FROM c),
l AS (SELECT *, (everything * 1.5::DOUBLE - filled) / open AS level FROM f),
t AS (SELECT source, source_size, w0, w1, least(cap, (SELECT level FROM l WHERE cap >= level * w ORDER BY cap / w, rank LIMIT 1) * w) AS target FROM l),
o AS (SELECT doc_id, size, source_size, target, w0, w1,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN start * 2 + size < target * 2 THEN 1 ELSE 0 END + CASE WHEN (start + source_size) * 2 + size < target * 2 THEN 1 ELSE 0 END AS copies,
             start / target AS x, (w1 - w0) / (w0 + w1) AS b FROM o)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies = 0 THEN NULL WHEN b = 0 THEN x ELSE (sqrt((1 - b) * (1 - b) + 4 * b * x) - (1 - b)) / (2 * b) END AS first_position
FROM p
"""
