"""Streaming forms: ingestion, deduplication, sessions, bursts and timelines. Input timestamps are TIMESTAMP; late rows beyond ``delay`` are dropped by the watermark.

Sessions, bursts, days and filled places come out once the watermark has passed them, so a stream holds back what is open at its end. ``drained`` runs
one to its end and then closes it: a last row, long after all others and with no key, moves the watermark past everything that was open.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators.catalogue import upserted
from shutterlake.operators.duplicates import blocking_keys, keyed_looks, new_links, new_pairs
from shutterlake.session import shared_dir
from shutterlake.sources.media import catalog_rows, media_type


def stream_catalog(spark: SparkSession, path: str) -> DataFrame:
    """New media files below ``path`` as they arrive, contents unread; other files and hidden folders are left out."""
    form = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(form).option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(path)
    own = files.select("path", "length", "modificationTime")
    return own.filter(media_type(F.col("path"))["supported"] & ~F.col("path").rlike(r"/(\.[^/]+|node_modules)/"))


#: Folders of a streamed catalogue; a batch rewrites those that its own paths fall into.
CATALOGUE_FOLDERS = 256


def catalogue_rows(spark: SparkSession, table: str, before: int | None = None, folders: list[int] | None = None) -> DataFrame:
    """The rows of the catalogue that ``stream_into_catalog`` keeps at ``table``: of each folder what its last batch (of those ``before`` a number) left. Only ``folders`` if given."""
    rows = spark.read.schema(f"{CATALOGUE}, batch int, folder int").parquet(table)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    if folders is not None:
        rows = rows.filter(F.col("folder").isin(folders))
    last = rows.groupBy("folder").agg(F.max("batch").alias("batch"))  # one row a folder
    return rows.join(F.broadcast(last), ["folder", "batch"]).drop("folder", "batch")


CATALOGUE = "file_path string, filename string, mime_type string, created_at timestamp"


def stream_into_catalog(files: DataFrame, table: str, folders: int = CATALOGUE_FOLDERS):
    """A writer of ``stream_catalog`` that upserts each batch by path. ``table`` has a folder for each batch and in it those hash folders, whole, that the batch has paths of, so bytes written follow the batch and a repeated batch replaces itself. ``folders`` is fixed for the life of a table; ``catalogue_rows`` reads it."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        none = F.lit(None).cast("timestamp")
        named = batch.withColumns({"taken_at": none, "digitized_at": none, "modified_at": F.col("modificationTime"), "exposure_s": F.lit(None).cast("double")})
        rows = catalog_rows(named).drop("exposure_time").withColumnRenamed("path", "file_path").persist()
        folder = F.pmod(F.xxhash64("file_path"), F.lit(folders)).cast("int").alias("folder")
        touched = [r.folder for r in rows.select(folder).distinct().collect()]  # ``folders`` at most
        old = catalogue_rows(spark, table, number, touched) if number else rows.limit(0)
        out = upserted(old, rows, "file_path", ["filename", "mime_type", "created_at"])
        out.select("*", folder).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{table}/batch={number}")
        rows.unpersist()

    return files.writeStream.foreachBatch(put)


def drained(rows: DataFrame, make, ts: str = "ts", mode: str = "append", close: bool = True) -> DataFrame:
    """What the stream ``make(source)`` gives of all of ``rows``, open ends included unless ``close`` is False; through the shared folder."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    out = make(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{base}/out")
    writer.start().awaitTermination()
    if close:
        last = rows.agg((F.max(ts) + F.expr("interval 1000 days")).alias(ts)).filter(F.col(ts).isNotNull())
        last.select(*[F.col(ts) if c == ts else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(f"{base}/in")
        writer.start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def stream_exact_dedup(df: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "210 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each key: start, end and rows."""
    out = df.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def stream_bursts(df: DataFrame, ts: str = "ts", slot: str = "4 seconds", delay: str = "1 minute") -> DataFrame:
    """Rows in each slot of time."""
    return df.withWatermark(ts, delay).groupBy(F.window(ts, slot).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("slot"), "n")


def stream_timeline(df: DataFrame, ts: str = "ts", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows per day, or per sliding day if ``slide`` is given."""
    window = F.window(ts, "1 day", slide) if slide else F.window(ts, "1 day")
    out = df.withWatermark(ts, delay).groupBy(window.alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n") if slide else out.select(F.to_date("w.start").alias("day"), "n")


#: Folders of stored keys; a batch reads those that its own keys fall into.
KEY_FOLDERS = 64


def stream_fingerprints(df: DataFrame, keys_path: str, pairs_path: str):
    """A writer that pairs each batch of fingerprints with the stored blocking keys, then stores its own. Keys are Parquet by hash folder and batch, pairs by batch, so that a repeated batch replaces itself and a batch reads only the folders that it has keys of."""

    def match(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        folder = F.pmod(F.xxhash64("key"), F.lit(KEY_FOLDERS)).cast("int")
        mine = blocking_keys(batch).withColumn("folder", folder)
        touched = [r.folder for r in mine.select("folder").distinct().collect()]
        empty = mine.limit(0)
        stored = spark.read.option("basePath", keys_path).schema("id long, family string, key string, batch int, folder int").parquet(keys_path) if number else empty
        stored = stored.filter(F.col("folder").isin(touched) & (F.col("batch") < number)) if number and touched else empty
        new_pairs(batch, stored).write.mode("overwrite").parquet(f"{pairs_path}/{number}")
        own = mine.withColumn("batch", F.lit(number))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "folder").parquet(keys_path)
        batch.unpersist()

    return df.writeStream.foreachBatch(match)


def stream_links(df: DataFrame, keys_path: str, links_path: str):
    """A writer that links each batch of fingerprints to one another and to the stored ones, as ``new_links`` does: links follow the rows of a batch, however hot a bucket is, and all batches' links together connect what ``complete_links`` of all rows connects. Ids must not come again in a later batch.

    Keys are kept as Parquet by batch and hash folder, links by batch, so that a repeated batch replaces itself and a batch reads only the folders that it has keys of.
    """

    def match(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, F.pmod(F.xxhash64("key"), F.lit(KEY_FOLDERS)).cast("int")
        mine = keyed_looks(batch).withColumn("folder", folder).persist()
        touched = [r.folder for r in mine.select("folder").distinct().collect()]  # ``KEY_FOLDERS`` at most
        stored = mine.limit(0)
        if number and touched:
            form = mine.drop("folder").withColumns({"batch": F.lit(0), "folder": F.lit(0)}).schema
            kept = spark.read.option("basePath", keys_path).schema(form).parquet(keys_path)
            stored = kept.filter(F.col("folder").isin(touched) & (F.col("batch") < number))
        new_links(mine, stored).write.mode("overwrite").parquet(f"{links_path}/batch={number}")
        mine.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "folder").parquet(keys_path)
        mine.unpersist()

    return df.writeStream.foreachBatch(match)
