"""Other file formats, databases and topics than the Parquet tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Options with which a format keeps nulls, quotes and line ends of texts apart.
OPTIONS: dict[str, dict[str, str]] = {
    "parquet": {},
    "orc": {},
    "json": {"ignoreNullFields": "false"},
    "csv": {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\\N"},
}


def read_table(spark: SparkSession, path: str, file_format: str, schema: str | None = None) -> DataFrame:
    """A table in one of the formats of OPTIONS; text formats need ``schema`` to be read in one pass."""
    reader = spark.read.format(file_format).options(**OPTIONS[file_format])
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, file_format: str, mode: str = "errorifexists") -> None:
    df.write.format(file_format).options(**OPTIONS[file_format]).mode(mode).save(path)


def read_database(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **properties: str) -> DataFrame:
    """A query's rows over JDBC, read in ``parts`` ranges of ``column`` where that is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **properties)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def _connector(spark: SparkSession, name: str) -> None:
    """Says what is missing where Spark has no connector of that name."""
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
    except Exception as missing:  # noqa: BLE001  the JVM's ClassNotFoundException comes as one of py4j's
        raise RuntimeError(f"the {name} connector is not among Spark's jars; start the session with its package") from missing


def read_topic(spark: SparkSession, servers: str, topic: str, schema: str, start: str = "earliest", **options: str) -> DataFrame:
    """A stream of a Kafka topic's JSON values as columns, with the record's key, partition, offset and time."""
    _connector(spark, "kafka")
    rows = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, **options}).load()
    return parsed_values(rows, schema)


def parsed_values(rows: DataFrame, schema: str) -> DataFrame:
    """Kafka's rows with their values parsed; a value that is no such JSON has nulls."""
    value = F.from_json(F.col("value").cast("string"), schema).alias("v")
    meta = [F.col("key").cast("string").alias("record_key"), F.col("partition").alias("record_partition"), F.col("offset").alias("record_offset"), F.col("timestamp").alias("record_time")]
    return rows.select(value, *meta).select("v.*", "record_key", "record_partition", "record_offset", "record_time")


def write_topic(df: DataFrame, servers: str, topic: str, key: str | None, checkpoint: str, **options: str) -> StreamingQuery:
    """A stream's rows as JSON values of a Kafka topic."""
    _connector(df.sparkSession, "kafka")
    return topic_rows(df, key).writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint, **options}).start()


def topic_rows(df: DataFrame, key: str | None) -> DataFrame:
    """key and value as Kafka takes them."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), value)
