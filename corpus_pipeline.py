"""The corpus pipeline: reject low quality, drop near-duplicates, cut benchmark
passages, pack.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of ``documents``; the last returns the packed pieces.  A
stage's result is written and read again before the next, so that a lost
executor costs no more than a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, minhash, packing, quality
from siltstone.llm.common import Scratch, free_name, table

#: Documents of a lower score are rejected.
LEAST_QUALITY = 0.3
#: Documents with more of their words in benchmark passages are dropped; of others the passages are cut.
MOST_COVERED = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is at least LEAST_QUALITY.

    Null and empty texts have the score of the bias and are kept or go together, as
    equal texts do; rows without an id are scored alike; every row of a repeated
    document is kept or goes.  Without labels every score is 0.5, and all stay.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    name = free_name("qc_score", docs.columns)
    scored = quality.score(docs, weights, score_col=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group that is tied by a similarity of 0.8 or more over five-word shingles, once for each of its texts.

    Null and empty texts, and those without words, are in no group and stay; rows
    without an id take part in the groups of their texts, behind all that have one;
    rows that repeat id and text leave one.
    """
    return minhash.one_of_each_group(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what occurs of a benchmark item (ten words in a row, or a whole shorter item), and drops documents that are mostly that.

    Null and empty texts stay as they are; items without an id count; every row of a
    repeated document is treated alike; without items nothing is cut.
    """
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"), window=10, least_words=1, max_coverage=MOST_COVERED, nameless=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 ids.

    A null or empty text is the end id alone; repeated rows are packed each; ids may
    be null; all other columns are left out.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", classify),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("packing", pack),
]
#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
