"""Delta-maintained token totals by source, language and tokenizer version.

A batch is a table of signed changes: an insert adds a document's count, a delete
takes it away, and a revised count is the old one with a minus and the new one
with a plus.  A batch is summed to a row for each (source, lang, tokenizer) before
it is shuffled or written, so a hot source costs one row a task.

The store is a folder.  A batch's sums are written under a name of that attempt,
and committed by a small marker file ``commits/<batch>.json`` that names the
attempt's files.  The marker is written under a temporary name and put in place
by one step that fails where there is a marker already (a hard link on a local
file system, else a rename without overwriting, which HDFS does as one step):
of two writers at once one wins, and the other is told so and removes its files.
Committing a batch again changes nothing; ``commit(.., compare=True)`` raises
BatchConflict where the repeated batch has other sums.  A writer that dies before
the marker is there leaves nothing that readers see.

Totals are the sums over the newest snapshot and the batches committed after it.
``compact`` lists the commits once, sums exactly those, and names them in the
snapshot's marker: a commit that lands meanwhile is not in the list, so it is
read beside the snapshot.  Readers open the markers of the batches after the
snapshot only; a name of each earlier one is kept, so that it stays committed.
``vacuum`` frees the files that no reader needs any more.

Defined cases: a null text counts as 0 tokens; null sources and languages are
groups of their own; repeated rows are counted as often as they occur; groups
whose documents are all gone are left out of the totals; an empty batch is
committed and changes nothing; a store without batches gives no rows.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Scratch, encoded, prepare, small, table
from .packing import encoder

KEYS = ("source", "lang", "tokenizer")
_SUMS = "source string, lang string, tokenizer string, documents long, tokens long"


def count_tokens(docs: DataFrame, tokenizer: str | None, version: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokenizer`` (the version) and ``tokens``; without a vocabulary file words are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer) if tokenizer else None
        for batch in small(batches):
            texts = [t.decode() if encode else t for t in encoded(batch.column(batch.schema.names.index(text_col)))]
            counts: list[int] = []
            for a in range(0, len(texts), 64):
                counts += map(len, encode(texts[a : a + 64]) if encode else (t.split() for t in texts[a : a + 64]))
            kept = [k for k, n in enumerate(batch.schema.names) if n != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())], names=[*(batch.schema.names[k] for k in kept), "tokenizer", "tokens"])

    prepare(docs.sparkSession)
    narrow = docs.drop("tokenizer", "tokens")
    fields = [f for f in narrow.schema.fields if f.name != text_col]
    return narrow.mapInArrow(run, T.StructType([*fields, T.StructField("tokenizer", T.StringType()), T.StructField("tokens", T.LongType())]))


def inserted(counts: DataFrame) -> DataFrame:
    """Changes that add documents: source, lang, tokenizer, documents, tokens."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).cast("long").alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace counts; a document may move to another source, language or tokenizer."""
    return deleted(old).union(inserted(new))


class BatchConflict(ValueError):
    """A batch's name was used for other changes."""


class Rollup:
    """Totals in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join([self.folder, *parts]))
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[str]:
        at = self._path(kind)
        if not self._fs.exists(at):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json"))

    def _mark(self, kind: str, name: str, content: dict) -> bool:
        """Puts a marker in place; False where another one has that name."""
        temporary, final = self._path(f"_{kind}-{uuid.uuid4().hex}"), self._path(kind, f"{name}.json")
        self._fs.mkdirs(self._path(kind))
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            placed = self._place(temporary, final)
        finally:
            self._fs.delete(temporary, False)
        # A step that was done although it seemed to fail put this very marker there.
        return placed or self._read(kind, f"{name}.json") == content

    def _place(self, temporary, final) -> bool:
        """Gives a file its final name in one step, unless there is a file of that name."""
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return self._renamed(temporary, final)

    def _renamed(self, temporary, final) -> bool:
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        rename = getattr(hadoop, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, final, how)
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
                raise
            return False
        return True

    def _read(self, kind: str, mark: str) -> dict:
        stream = self._fs.open(self._path(kind, mark))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def is_committed(self, batch: str) -> bool:
        return self._fs.exists(self._path("commits", f"{_name(batch)}.json"))

    def commit(self, batch: str, changes: DataFrame, compare: bool = False) -> bool:
        """Adds a batch once; False where it was committed before, by this writer or another.

        With ``compare`` a batch that was committed with other sums is an error;
        without it ``changes`` of a committed batch are not read.
        """
        if self.is_committed(batch):
            if compare:
                self._same(batch, _summed(changes))
            return False
        data = f"data/{_name(batch)}-{uuid.uuid4().hex}"
        _summed(changes).write.parquet(f"{self.folder}/{data}")
        if self._mark("commits", _name(batch), {"data": data}):
            return True
        if compare:
            self._same(batch, self._sums([data]))
        self._fs.delete(self._path(data), True)
        return False

    def _same(self, batch: str, sums: DataFrame) -> None:
        data = self._read("commits", f"{_name(batch)}.json")["data"]
        if not self._fs.exists(self._path(data)):
            raise BatchConflict(f"the sums of batch {batch} were freed, so they can't be compared")
        held = self._sums([data])
        if sums.exceptAll(held).union(held.exceptAll(sums)).limit(1).count():
            raise BatchConflict(f"batch {batch} was committed with other sums")

    def _sums(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], _SUMS)
        return self.spark.read.schema(_SUMS).parquet(*(f"{self.folder}/{p}" for p in paths))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches."""
        return _summed(self._committed(self._marks("commits"))).where("documents <> 0 or tokens <> 0")

    def _committed(self, commits: list[str]) -> DataFrame:
        """Sums of these commits; those that a snapshot holds are read from it."""
        held: dict = {"data": None, "commits": []}
        for mark in reversed(self._marks("snapshots")):
            held = self._read("snapshots", mark)
            if set(held["commits"]) <= set(commits):
                break
            held = {"data": None, "commits": []}  # newer than the list
        inside = set(held["commits"])
        after = [self._read("commits", m)["data"] for m in commits if m not in inside]
        return self._sums([p for p in (held["data"], *after) if p])

    def compact(self) -> None:
        """Writes the totals so far as a snapshot, so that later reads start from it."""
        commits, snapshots = self._marks("commits"), self._marks("snapshots")
        number = int(snapshots[-1].partition(".")[0]) + 1 if snapshots else 0
        data = f"data/snapshot-{uuid.uuid4().hex}"
        _summed(self._committed(commits)).write.parquet(f"{self.folder}/{data}")
        if not self._mark("snapshots", f"{number:09d}", {"data": data, "commits": commits}):
            self._fs.delete(self._path(data), True)  # another compaction came first

    def vacuum(self, keep: int = 2) -> None:
        """Frees all snapshots but the newest ``keep``, and the sums of batches that the oldest of these holds.

        Markers of batches stay, so that no batch is counted again.  Totals that
        were begun before may no longer find their files, and are to be taken anew.
        """
        snapshots = self._marks("snapshots")
        if not snapshots:
            return
        kept, gone = snapshots[-max(1, keep) :], snapshots[: -max(1, keep)]
        for mark in self._read("snapshots", kept[0])["commits"]:
            self._fs.delete(self._path(self._read("commits", mark)["data"]), True)
        for mark in gone:
            data = self._read("snapshots", mark)["data"]
            self._fs.delete(self._path("snapshots", mark), False)
            self._fs.delete(self._path(data), True)


def _name(batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a batch is named by letters, digits, dots, dashes and underscores")
    return batch


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after inserts, a revision, deletes and repeated commits.

    Documents come in with estimates (a token for four characters), which true
    counts of the byte-level BPE vocabulary and of words replace; documents
    without any word are deleted.
    """
    import public_tokenizers

    scratch = Scratch(spark, "token-counts")
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    bpe, words = "byte_bpe_50k", "words"
    both = count_tokens(docs.withColumn("copy", F.col("text")), public_tokenizers.path("byte_bpe_50k.json"), bpe)
    # One reading of the texts gives both counts and the estimate.
    estimate = F.ceil(F.coalesce(F.length("copy"), F.lit(0)) / 4)
    measured = both.withColumn("estimate", estimate).withColumnsRenamed({"tokens": "bpe_tokens"}).drop("tokenizer")
    counts = scratch.save(count_tokens(measured, None, words, text_col="copy").select("source", "lang", "estimate", "bpe_tokens", F.col("tokens").alias("word_tokens")), "counts")
    of = lambda column, version: counts.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(column).alias("tokens"), "word_tokens")

    store = Rollup(spark, scratch.path("store"))
    first = inserted(of("estimate", bpe)).union(inserted(of("estimate", words)))
    store.commit("inserts", first)
    true = of("bpe_tokens", bpe).union(of("word_tokens", words))
    store.commit("revisions", revised(of("estimate", bpe).union(of("estimate", words)), true))
    store.commit("inserts", first)  # a repeated batch changes nothing
    store.compact()
    store.commit("deletes", deleted(true.where("word_tokens = 0")))
    store.commit("revisions", first)
    return store.totals()
