"""Incremental preparation: pages and chunks that arrive as files, worked off once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import docs


def prepare_stream(spark: SparkSession, source: str, target: str, checkpoint: str, lateness: str = "7 days", files_per_batch: int = 64) -> StreamingQuery:
    """Reads chunk files (parquet) under ``source`` as they come and writes prepared documents to ``target``.

    What is there is worked off in batches and the query ends. A chunk whose id is in ``target`` is not written again,
    however late it comes, and no chunk is left out for its age: ``lateness`` bounds nothing and is only still accepted.
    A batch that is run again after a failure finds what it had written. ``target`` and ``checkpoint`` of the earlier
    file sink can't be carried on, since readers of such a target see only what that sink has listed.
    """
    schema = spark.read.parquet(source).schema
    docs.prepared(spark.createDataFrame([], schema)).write.mode("append").parquet(target)

    def write(batch: DataFrame, number: int) -> None:
        written = batch.sparkSession.read.parquet(target).select("id")
        docs.prepared(batch).dropDuplicates(["id"]).join(written, "id", "left_anti").write.mode("append").parquet(target)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(rows: DataFrame, every: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(from, to, chunks, pages) by window of crawl time; works on streams and on tables."""
    window = F.window("crawled_at", every)
    counted = rows.withWatermark("crawled_at", lateness) if rows.isStreaming else rows
    return counted.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("chunks"), F.approx_count_distinct("url").alias("pages")).select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "chunks", "pages")
