"""A keyed table that a stream keeps up to date, and the feed of its changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import latest
from ..storage import children, exists, remove


@dataclass(frozen=True)
class ChangeFeed:
    """A versioned table below ``path``: the last write of each key, by ``order``.

    ``changes/batch=N`` has the last write of each key that a micro-batch wrote, ``base/batch=N`` the whole table as of
    batch N. Every ``every`` batches the changes since the last base are merged into a new one, and what
    two bases say is removed; so a reader that began with the base before can finish. A batch that runs again replaces itself,
    and one that a base has taken in already is left out: a replay changes nothing, whatever it is cut by.
    """

    path: str
    key: str = "id"
    order: str = "seq"
    every: int = 10

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Batches that are there whole."""
        found = [int(n.split("=")[1]) for n in children(spark, f"{self.path}/{kind}") if n.startswith("batch=")]
        return sorted(n for n in found if exists(spark, f"{self.path}/{kind}/batch={n}/_SUCCESS"))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in a micro-batch, as foreachBatch gives it. Of a key's rows the one of the highest order counts; null keys are a key."""
        spark = batch.sparkSession
        bases = self._numbers(spark, "base")
        if bases and number <= bases[-1]:
            return
        latest(batch, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}")
        if (number + 1) % self.every == 0:
            self.compact(spark, number)

    def compact(self, spark: SparkSession, number: int) -> None:
        table = self.current(spark, number)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{self.path}/base/batch={number}")
        bases = self._numbers(spark, "base")
        if len(bases) > 1:
            for kind in ("base", "changes"):
                for n in self._numbers(spark, kind):
                    if n < bases[-2] or (kind == "changes" and n == bases[-2]):
                        remove(spark, f"{self.path}/{kind}/batch={n}")

    def _read(self, spark: SparkSession, kind: str, numbers: list[int]) -> list[DataFrame]:
        return [spark.read.parquet(*[f"{self.path}/{kind}/batch={n}" for n in numbers])] if numbers else []

    def current(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """The table, as of a batch if given (no earlier than the last base but one); None before the first."""
        within = lambda n: upto is None or n <= upto
        bases = [n for n in self._numbers(spark, "base") if within(n)]
        since = bases[-1] if bases else -1
        parts = self._read(spark, "base", bases[-1:]) + self._read(spark, "changes", [n for n in self._numbers(spark, "changes") if since < n and within(n)])
        if not parts:
            return None
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return latest(both, self.key, self.order)

    def changes(self, spark: SparkSession, after: int = -1) -> DataFrame | None:
        """What observers are told: the rows that each batch after ``after`` wrote, with its number as ``batch``. None if there are none yet."""
        numbers = [n for n in self._numbers(spark, "changes") if n > after]
        if not numbers:
            return None
        return spark.read.option("basePath", f"{self.path}/changes").parquet(*[f"{self.path}/changes/batch={n}" for n in numbers]).withColumn("batch", F.col("batch").cast("long"))

    def start(self, stream: DataFrame, checkpoint: str, mode: str = "append"):
        """Start a query that keeps the table up to date with a stream (in update mode for a stream of aggregates)."""
        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(self.apply).start()
