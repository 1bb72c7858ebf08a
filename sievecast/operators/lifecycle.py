"""Life cycle of diagnostics over passes: upserts, resolution, retention, turns and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import SEVERITIES
from ..functions.text import clip_snippet


def latest(records: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last write of each key: ``max_by`` combines before the shuffle, where a window would move every version."""
    columns = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def status(passes: DataFrame, emitted: DataFrame) -> DataFrame:
    """``id, file_path, last_seen, status, resolved_at`` from passes (file_path, pass) and what each emitted (file_path, pass, id).

    A diagnostic is resolved once a later pass of its file does not emit it: if it was last seen before
    its file's last pass. It was resolved at the first pass after that.
    """
    seen = emitted.groupBy("id", "file_path").agg(F.max("pass").alias("last_seen"))
    following = passes.select("file_path", "pass").distinct().withColumn("_next", F.lead("pass").over(Window.partitionBy("file_path").orderBy("pass")))
    joined = seen.join(following.withColumnRenamed("pass", "last_seen"), ["file_path", "last_seen"])
    return joined.select("id", "file_path", "last_seen", F.when(F.col("_next").isNull(), "emitted").otherwise("resolved").alias("status"), F.col("_next").alias("resolved_at"))


def evict(records: DataFrame, most: int = 500, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Records without the oldest resolved ones over ``most`` of each session; active ones are never dropped."""
    w = Window.partitionBy(*by)
    resolved = F.col("status") == "resolved"
    oldest = F.row_number().over(w.partitionBy(*by, resolved).orderBy("last_seen", *[c for c in ("id", "severity", "rule", "message", "file_path") if c in records.columns]))
    ranked = records.withColumn("_over", F.count("*").over(w) - most).withColumn("_rank", oldest)
    return ranked.filter(~(resolved & (F.col("_rank") <= F.col("_over")))).drop("_over", "_rank")


def assign_turns(events: DataFrame) -> DataFrame:
    """Events (session_id, seq, kind, ...) with the number of their turn: how many turns ended before, in their session."""
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("turn", F.coalesce(F.sum(F.when(F.col("kind") == "turn_end", 1).otherwise(0)).over(before), F.lit(0)))


def first_snapshots(events: DataFrame) -> DataFrame:
    """``session_id, turn, file_path, content``: what each file was before a turn's first edit of it."""
    edits = events.filter((F.col("kind") == "tool_call") & F.col("tool_name").isin("edit", "write"))
    return edits.groupBy("session_id", "turn", "file_path").agg(F.min_by("content", "seq").alias("content"))


def coerce(diagnostics: DataFrame) -> DataFrame:
    """Untyped diagnostics with defaults: warning, line and column 0, radius 1, and an id made of their fields if they have none."""
    out = diagnostics.withColumns({"severity": F.coalesce("severity", F.lit("warning")), "line": F.coalesce("line", F.lit(0)), "col": F.coalesce("col", F.lit(0)), "blast_radius": F.coalesce("blast_radius", F.lit(1))})
    made = F.sha2(F.to_json(F.struct("file_path", "line", "col", "severity", "rule", "message")), 256)
    return out.withColumn("id", F.coalesce("id", made))


_HARVESTED = "struct<details:struct<diagnostics:array<struct<id:string,filePath:string,line:int,column:int,severity:string,rule:string,message:string,source:string,hasFix:boolean,fixCount:int,blastRadius:int>>>>"


def harvest(events: DataFrame) -> DataFrame:
    """Diagnostics that tool results carry in their payload (JSON, ``details.diagnostics``): session_id, seen and typed fields with defaults.

    Fields of another type count as missing; a severity that is none of the four is a warning; without an
    id, one is made of the fields. A payload that is no JSON, or has no list, gives no rows.
    """
    d = events.select("session_id", F.col("seq").alias("seen"), F.explode(F.from_json("payload", _HARVESTED)["details"]["diagnostics"]).alias("d")).filter("d is not null").select("session_id", "seen", "d.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = d.select("session_id", "seen", "id", text("filePath").alias("file_path"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("column", F.lit(0)).alias("col"), F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("warning").alias("severity"), text("rule").alias("rule"), text("message").alias("message"), text("source").alias("source"), F.coalesce("hasFix", F.lit(False)).alias("has_fix"), F.coalesce("fixCount", F.lit(0)).alias("fix_count"), F.coalesce("blastRadius", F.lit(1)).alias("blast_radius"))
    made = F.sha2(F.to_json(F.struct("file_path", "line", "col", "severity", "rule", "message")), 256)
    return out.withColumn("id", F.coalesce("id", made))


def revive(records: DataFrame, harvested: DataFrame) -> DataFrame:
    """``session_id, id, status, first_seen, last_seen`` after new sightings (session_id, id, seen): a known record keeps when it was first seen and is emitted again, if it was resolved; a new one begins with its first sighting."""
    old = records.select("session_id", "id", "status", "first_seen", "last_seen", F.lit(False).alias("_new"))
    new = harvested.select("session_id", "id", F.lit("emitted").alias("status"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), F.lit(True).alias("_new"))
    g = old.unionByName(new).groupBy("session_id", "id").agg(F.max_by("status", "_new").alias("_status"), F.bool_or("_new").alias("_seen"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return g.select("session_id", "id", F.when(F.col("_seen"), "emitted").otherwise(F.col("_status")).alias("status"), "first_seen", "last_seen")


def with_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of other tools with the line that they are about, clipped; null for whole files, lines that aren't there and files that aren't.

    Texts are made of narrow rows, by whose size Spark would judge a join: the hint keeps them from being broadcast.
    """
    texts = files.select("file_path", F.col("content").alias("_content")).hint("merge")
    text = clip_snippet(F.get(F.split("_content", "\n"), F.col("line") - 1))
    return findings.join(texts, "file_path", "left").withColumn("snippet", F.when(F.col("line") > 0, text)).drop("_content")
