"""Where results go: tables with a layout, and a corpus' relations as files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siltstone.lineage.corpus import Corpus

#: Relations that are written for a corpus.
RELATIONS = ("statements", "entities", "table_edges", "column_edges", "transformations", "references", "cte_order")


def create_table_as(df: DataFrame, name: str, partitioned_by: list[str] = (), clustered_by: list[str] = (), buckets: int = 0, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    """CREATE TABLE name AS query, partitioned and bucketed as asked.

    Rows are dealt by the partition columns first, so that a partition is a few
    files rather than one from every task; a large partition is split.
    """
    if partitioned_by:
        df = df.hint("rebalance", *partitioned_by)
    writer = df.write.mode(mode).format(file_format)
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    if clustered_by:
        writer = writer.bucketBy(buckets or 8, *clustered_by).sortBy(*clustered_by)
    writer.saveAsTable(name)


def write_corpus(corpus: Corpus, folder: str, file_format: str = "parquet", mode: str = "overwrite") -> None:
    """Each relation of a corpus as a folder of its own; statements are parsed once, all else reads that."""
    parsed = f"{folder}/parsed"
    corpus.parsed.write.mode(mode).parquet(parsed)
    stored = Corpus(corpus.parsed.sparkSession.read.parquet(parsed))
    for name in RELATIONS:
        getattr(stored, name)().write.mode(mode).format(file_format).save(f"{folder}/{name}")
