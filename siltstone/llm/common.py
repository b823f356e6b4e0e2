"""Shared pieces of the training-data operators: scratch storage in the
cluster's shared folder, and vectorised word hashing over Arrow buffers.

Scratch tables are written under ``spark.checkpoint.dir`` (read from the
session).  Only where that setting is absent, as in local tests, is a local
folder made and registered instead.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.session import ship

#: A-Z to a-z, every other byte unchanged.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_U64 = np.uint64
_MULT = _U64(0x9E3779B97F4A7C15)


#: Bytes of a batch that Spark hands to Python; its own default is eight times as much.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def prepare(spark: SparkSession) -> None:
    """Gives executors the code, and bounds batches by bytes where the session does not say how.

    Texts can be long, and a batch is held by the JVM and by the Python worker at once.
    """
    ship(spark)
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a trailing slash."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        told = spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        told = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


_ROOTS: list[str] = []
_OWNER = os.getpid()


@atexit.register
def _sweep_at_exit() -> None:
    """Frees the shared folder when the driver's process ends with its session still there."""
    spark = SparkSession.getActiveSession() if _ROOTS and os.getpid() == _OWNER else None
    if spark is not None:
        with contextlib.suppress(Exception):
            sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Removes all that operators of this process left in the shared folder; their results can't be read after it."""
    scratch = Scratch(spark, "sweep")
    while _ROOTS:
        scratch.remove(_ROOTS.pop())


class Scratch:
    """Tables of one operator run, as Parquet in the shared folder.

    ``save`` cuts the lineage: a lost executor costs a re-read, not a re-run.
    ``drop`` frees a table that no later step reads; ``sweep`` all that is left.
    """

    def __init__(self, spark: SparkSession, label: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _ROOTS.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        at = self.path(f"{self._n:03d}-{name}")
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._scratch_path)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def small(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes, so that what a task makes of one stays small.

    Python workers outlive their tasks; what this one no longer uses goes back to
    the system at its end, so that the next finds room.
    """
    try:
        for batch in batches:
            n = batch.num_rows
            step = max(1, min(n, n * limit // max(1, batch.nbytes)))
            for a in range(0, n, step):
                yield batch.slice(a, step)
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """The name, or a longer one, that no column has."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def encoded(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 64), _MULT)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def word_table(separators: bytes) -> np.ndarray:
    """Byte lookup: 0 for a separator, else 1 + the byte in lower case."""
    lut = np.frombuffer(LOWER, np.uint8).astype(np.uint64) + _U64(1)
    lut[np.frombuffer(separators, np.uint8)] = 0
    return lut


#: Words are [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_TABLE = word_table(SPACES)


def word_spans(data: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and byte values (see word_table) of the words in ``data``."""
    value = lut[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = value != 0
    edge = np.diff(inside)
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts, value


def hash_words(data: np.ndarray, lut: np.ndarray = SPACE_TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and 64-bit hashes of the words in the bytes ``data``."""
    starts, lengths, value = word_spans(data, lut)
    if not len(starts):
        return starts, lengths, np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        first = int(starts[0])
        place = np.zeros(len(data), np.int64)
        place[first:] = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    place[value == 0] = 0
    total = np.add.reduceat(value * _powers(int(lengths.max()) + 1)[place], starts)
    return starts, lengths, mix(total + lengths.astype(np.uint64) * _U64(0xD6E8FEB86659FD93))


#: Bytes hashed at once; temporaries take about 40 times as much.
CHUNK = 1 << 20


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``limit`` bytes, or one longer text."""
    a, held = 0, 0
    for b, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield a, b
            a, held = b, 0
        held += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def _pieces(data: np.ndarray, lut: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts a long text at separators, so that no piece but a single long word passes ``limit``."""
    a = 0
    while len(data) - a > limit:
        gap = np.flatnonzero(lut[data[a + 1 : a + limit]] == 0)
        if len(gap):
            b = a + 1 + int(gap[-1])
        else:
            b = a + limit
            while b < len(data) and lut[data[b]]:
                b += 1
        yield a, b
        a = b
    yield a, len(data)


def hashed_texts(texts: list[bytes], lut: np.ndarray = SPACE_TABLE, joiner: bytes = b" ") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, past-last, word hashes of all, and each text's first word (one more at the end)."""
    for a, b in chunks(texts):
        if b == a + 1 and len(texts[a]) > 4 * CHUNK:
            data = np.frombuffer(texts[a], np.uint8)
            words = np.concatenate([hash_words(data[x:y], lut)[2] for x, y in _pieces(data, lut, CHUNK)])
            yield a, b, words, np.array([0, len(words)])
            continue
        data = np.frombuffer(joiner.join(texts[a:b]), np.uint8)
        starts, _, words = hash_words(data, lut)
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        yield a, b, words, np.concatenate([[0], np.searchsorted(starts, ends)])
