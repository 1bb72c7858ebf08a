"""Metrics kept by content: a run computes only what no run before it has seen."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import children, exists, remove
from .rules import file_metrics


@dataclass(frozen=True)
class MetricStore:
    """Metrics by the hash of contents, in a folder: ``run=N/new`` has what run N computed, ``run=N/used`` the hashes that it met.

    ``compute`` takes (file_path, content) to a row a file; a content is computed once, whatever its paths.
    What no run met for ``keep`` runs is forgotten when a run :meth:`expire` s.
    """

    path: str
    compute: Callable[[DataFrame], DataFrame] = file_metrics
    keep: int = 30

    def _runs(self, spark: SparkSession, kind: str) -> list[int]:
        found = [int(n.split("=")[1]) for n in children(spark, self.path) if n.startswith("run=")]
        return sorted(n for n in found if exists(spark, f"{self.path}/run={n}/{kind}/_SUCCESS"))

    def stored(self, spark: SparkSession) -> DataFrame | None:
        """``hash`` and the metrics of all that is kept; None if nothing is. Two runs at once may both have a hash: one row stands."""
        runs = self._runs(spark, "new")
        return spark.read.parquet(*[f"{self.path}/run={n}/new" for n in runs]).dropDuplicates(["hash"]) if runs else None

    def run(self, files: DataFrame, number: int) -> DataFrame:
        """``file_path`` and the metrics of ``files`` (file_path, content), of which only unknown contents are computed and added as run ``number``.

        A run that is done again replaces itself. Null contents have no metrics; equal paths come out as often.
        """
        spark = files.sparkSession
        hashed = files.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "content")
        earlier = [n for n in self._runs(spark, "new") if n != number]
        new = hashed.filter("hash IS NOT NULL")
        if earlier:
            known = spark.read.parquet(*[f"{self.path}/run={n}/new" for n in earlier]).select("hash")
            new = new.join(known, "hash", "left_anti")
        # one content of each hash: partial aggregation, so copies do not travel
        one = new.groupBy("hash").agg(F.first("content").alias("content")).select(F.col("hash").alias("file_path"), "content")
        self.compute(one).withColumnRenamed("file_path", "hash").write.mode("overwrite").parquet(f"{self.path}/run={number}/new")
        hashed.select("hash").filter("hash IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/run={number}/used")
        return hashed.select("file_path", "hash").join(self.stored(spark), "hash", "left").drop("hash")

    def computed(self, spark: SparkSession, number: int) -> int:
        """How many contents run ``number`` computed."""
        return spark.read.parquet(f"{self.path}/run={number}/new").count()

    def expire(self, spark: SparkSession, number: int) -> None:
        """Forget what none of the last ``keep`` runs up to ``number`` met. The kept rows of older runs become part of run ``number``; then the older folders go."""
        used = self._runs(spark, "used")
        recent = [n for n in used if number - self.keep < n <= number]
        old = [n for n in self._runs(spark, "new") if n <= number - self.keep]
        if not old or not recent:
            return
        met = spark.read.parquet(*[f"{self.path}/run={n}/used" for n in recent]).distinct()
        rows = spark.read.parquet(*[f"{self.path}/run={n}/new" for n in old])
        target = max(old)
        rows.dropDuplicates(["hash"]).join(met, "hash", "left_semi").write.mode("overwrite").parquet(f"{self.path}/run={target}.kept/new")
        kept = spark.read.parquet(f"{self.path}/run={target}.kept/new")
        for n in old:
            if n != target:
                remove(spark, f"{self.path}/run={n}")
        kept.write.mode("overwrite").parquet(f"{self.path}/run={target}/new")
        remove(spark, f"{self.path}/run={target}/used")
        remove(spark, f"{self.path}/run={target}.kept")
