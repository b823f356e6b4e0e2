"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Features of a text are the one- and two-word n-grams of its lower-cased words
and of its word forms, hashed into ``2**bits`` slots.  A word's form says which
kinds of characters it has, how its punctuation repeats, and whether it equals
the word before.  A slot's value is its share of the text's n-grams, so a text's
length does not move its score.

Training takes at most ``max_rows`` labelled rows (8,000 by default), those
with the least hashes of their id, and runs in one task of that bounded size;
an executor that dies there costs one repeated task.  Scoring reads every whole
text once, without a shuffle; what is broadcast is the weights, 8 * 2**bits bytes.

Defined cases: a null or empty text has no n-grams and scores as the bias alone;
null labels and labels of unknown documents are left out; a document with
several labels is learned from each; of a labelled id with many rows at most
``max_texts`` are learned from; rows without an id are scored, and learned from by
no label; a text of any length is scored whole; equal texts score alike; without
labels every score is 0.5; an empty table gives no rows.  ``score`` keeps all
columns but one of the name that it adds (in any case, as Spark compares names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import types as T

from .common import SPACE_TABLE, encoded, hashed_texts, mix, prepare, small, table, word_spans

BITS = 18
_U64 = np.uint64
_SEEDS = tuple(_U64(x) for x in (0x8A5CD789635D2DFF, 0x121FD2155C472F96, 0xB5026F5AA96619E9, 0x3C6EF372FE94F82B))

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _forms(text: bytes, words: np.ndarray) -> np.ndarray:
    """A small code for the form of each word."""
    data = np.frombuffer(text, np.uint8)
    starts, lengths, _ = word_spans(data, SPACE_TABLE)
    if not len(starts):
        return np.zeros(0, np.uint64)
    count = lambda kind: np.add.reduceat(kind[data].astype(np.int32), starts)
    upper, digit, sign = count(_UPPER), count(_DIGIT), count(_SIGN)
    rest = lengths - upper - digit - sign
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    code = (upper > 0) + 2 * (upper > 1) + 4 * (rest > 0) + 8 * (digit > 0) + 16 * np.minimum(sign, 3) + 64 * same
    return code.astype(np.uint64)


def features(texts: list[bytes], bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, past-last, slots of all n-grams, and where each text's begin (one more at the end)."""
    down = _U64(64 - bits)
    for a, b, words, at in hashed_texts(texts):
        parts, sizes = [], []
        for k in range(a, b):
            w = words[at[k - a] : at[k - a + 1]]
            f = _forms(texts[k], w)
            n = 0
            for grams, one, two in ((w, _SEEDS[0], _SEEDS[1]), (f, _SEEDS[2], _SEEDS[3])):
                parts.append(mix(grams ^ one) >> down)
                n += len(grams)
                if len(grams) > 1:
                    parts.append(mix(mix(grams[:-1] ^ two) + grams[1:]) >> down)
                    n += len(grams) - 1
            sizes.append(n)
        slots = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        yield a, b, slots, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Ftrl:
    """Follow-the-regularised-leader, proximal, on the logistic loss; slot ``size`` is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


#: The n-grams' shares are small; this scale lets the updates move as fast as the bias.
SCALE = 20.0


Row = tuple[np.ndarray, np.ndarray, int]


def training_rows(texts: list[bytes], labels: list[int], bits: int = BITS) -> Iterator[Row]:
    """Distinct slots, their counts and the label of each text."""
    for a, b, slots, at in features(texts, bits):
        for k in range(b - a):
            s, c = np.unique(slots[at[k] : at[k + 1]], return_counts=True)
            yield s.astype(np.int32), c.astype(np.int32), labels[a + k]


def fit(rows: list[Row], bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Weights of all slots and the bias, after ``epochs`` passes in the given order."""
    model = Ftrl(1 << bits)
    for _ in range(epochs):
        for s, c, y in rows:
            model.learn(np.append(s, 1 << bits), np.append(c * (SCALE / max(1, c.sum())), 1.0), y)
    return model.weights()


def scores(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    out = np.full(len(texts), weights[-1])
    for a, b, slots, at in features(texts, bits):
        size = np.diff(at)
        some = np.flatnonzero(size)
        if len(some):  # each text is summed on its own, so that equal texts score alike to the last bit
            out[a + some] += SCALE * np.add.reduceat(weights[slots], at[some]) / size[some]
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 8_000, max_texts: int = 4, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights learned from at most ``max_rows`` labels, and ``max_texts`` rows of ``docs`` for each, in the order of their ids' hashes."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    # Hashes are even over 64 bits: a few more than max_rows are below this one, and no more are sorted.
    below = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 1.25 * max_rows / max(1, usable.count()))))
    picked = usable.where(F.xxhash64("id") <= below).orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    bounded = F.broadcast(picked)  # max_rows rows of an id and a label at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(bounded, "id")
    # An id that very many rows repeat is cut before it is shuffled.
    order = F.row_number().over(Window.partitionBy("id", "label").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("nth", order).where(F.col("nth") <= max_texts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Row] = []
        for batch in small(batches):
            held += training_rows(encoded(batch.column(0)), batch.column(1).to_pylist(), bits)
        w = fit(held, bits) if held else np.zeros((1 << bits) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label", "text").select("text", "label")
    prepare(docs.sparkSession)
    found = one.mapInArrow(learn, "weights binary").collect()  # one row; none if there is nothing to learn from
    return np.frombuffer(found[0][0]) if found else np.zeros((1 << bits) + 1)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the likelihood of label 1 (a column of that name is replaced)."""
    prepare(docs.sparkSession)
    docs = docs.drop(score_col)
    told = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = encoded(batch.column(batch.schema.names.index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(texts, told.value, bits), pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def op3_quality(spark: SparkSession, sf_dir: str, bits: int = BITS) -> DataFrame:
    """Scores of all documents by weights learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels").where(~held_out()), bits=bits)
    out = score(docs, weights, bits)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
