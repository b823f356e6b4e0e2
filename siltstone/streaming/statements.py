"""Provenance of statements as they arrive."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltstone.lineage.corpus import Corpus, parse_statements


def stream_table_edges(statements: DataFrame, folder: str, checkpoint: str, dialect: str = "trino", once: bool = False) -> StreamingQuery:
    """Writes the edges of a stream of statements (stmt_id, sql) to ``folder``.

    A batch has a folder of its own, which a repeated run of that batch replaces;
    after a failure nothing is missing and nothing there twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        edges = Corpus(parse_statements(batch, dialect)).table_edges()
        edges.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = statements.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_stream(table: DataFrame, spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of ``name``.parquet, a file or a folder of files; ``table`` gives its columns."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(table.schema)
    return reader.parquet(f"{folder}/{name}.parquet") if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def write_last(windows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All windows after each batch, as one table of that batch; what is there now is read to its end."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return windows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_written(spark: SparkSession, folder: str) -> DataFrame:
    """The table of the last batch that ``write_last`` wrote."""
    every = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    return every.where(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None, time_col: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by time window; rows later than ``late`` are dropped, state older than that is freed.

    The same definition serves streams and tables.
    """
    at = F.col(time_col).cast("timestamp")
    windows = F.window("at", size, slide) if slide else F.window("at", size)
    rows = events.withColumn("at", at).withWatermark("at", late)
    out = rows.groupBy(windows.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time_col: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of each key: runs of events with no longer gap between them."""
    rows = events.withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.session_window("at", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
