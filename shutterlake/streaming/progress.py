"""Progress of streaming queries as a table, kept by a listener.

Spark tells a listener of every batch, while a query object remembers only the last ones and forgets all with its process. Each batch that read rows is one
small folder, named by query and batch, so that a batch run again after a restart replaces its own entry and is never counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

FORM = "name string, n long, seconds double, at timestamp, query string, batch long"


class ProgressTable(StreamingQueryListener):
    """A listener that writes each batch's rows, seconds and start below ``path``; ``spark.streams.addListener(ProgressTable(spark, path))``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            row = self.spark.createDataFrame([(p.name, p.numInputRows, p.batchDuration / 1000, p.timestamp)], "name string, n long, seconds double, at string")
            row.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={p.id}/batch={p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def scan_progress(spark: SparkSession, path: str, total: int | None = None) -> DataFrame:
    """By query of the table at ``path``: batches, rows done, rows left of ``total`` (null if not given), rows a second over all batches, and the start of the last one. ``path`` must exist."""
    done = spark.read.schema(FORM).parquet(path).groupBy("query").agg(F.max("name").alias("name"), F.count("*").alias("batches"), F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.max("at").alias("at"))
    left = F.greatest(F.lit(0), F.lit(total) - F.col("n")) if total is not None else F.lit(None)
    return done.select("query", "name", "batches", "n", left.cast("long").alias("left"), F.try_divide("n", "seconds").alias("per_s"), "at")
