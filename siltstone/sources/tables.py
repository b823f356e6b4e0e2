"""Parquet tables of one folder, by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import ship


class Tables:
    """``tables("orders")`` is the scan of ``orders.parquet``; filters and columns reach the files."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """A query written as SQL text over the named tables; nothing is registered in the session."""
        for n in names:
            text = re.sub(rf"(\b(?:FROM|JOIN)\s+|,\s*){n}\b(?!\s*\.)", rf"\g<1>{{{n}}}", text)
        return self.spark.sql(text, **{n: self(n) for n in names})
