"""Document likelihood over a subword lattice.

An existing vocabulary's pieces and scores weight all segmentations of a text;
a forward recursion in log space sums over them and returns the marginal
probability of the document.  Pieces never cross a word, so the lattice of a
document falls apart into those of its words, and each distinct word is run
through the recursion once, however often it occurs.

The weights.  A merge-based vocabulary scores a piece by minus its rank, which
is no log-probability; ranks are turned into one by Zipf's law,
``p ~ 1 / (rank + 2.7)``, normalised over the pieces.  With ``adapt``, expected
counts of the pieces over the training words (one forward-backward pass under
those weights) are added to the prior's ``strength`` pseudo-counts; the
vocabulary itself is never trained.  Bytes outside the vocabulary are spelled by
its byte pieces, so every text has a probability above 0.  With ``word_edges`` a
word that was seen c times among the N training tokens has one more edge, over the
whole word, of the weight c / (N + V), V being the number of distinct words; its
segmentations share the rest, V / (N + V) (the estimate of Witten and Bell).

A text is scored as its sequence of tokens: a piece may begin with the mark of a
word's beginning, and which white space stands between words does not count.

The data.  Training counts, piece counts and document sums cover all rows.
Words of the highest counts (as many as fit into ``hot_bytes``, at most 256 bytes
each, long ones by their digest) are broadcast, and most tokens of a document are summed where it is read; the rest
are shuffled as (document, word, count) and joined with the word table.  Words in
the broadcast are those above a count that a histogram of counts gives, so that
no more than they reach the driver; any other word is rarer, and no join key hot.

Defined cases: a null or empty text is the end token alone; repeated rows and
doc_ids are scored and learned from as often as they occur; a null doc_id is
neither held out nor dropped; with no training rows every count is 0 and the
weights are the prior's; an empty table gives no rows.  Other columns are not
read, whatever their names.  Very long texts and words are scored whole; a task
hands on its counts once its words take COUNT_BYTES.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, Scratch, encoded, small, table

#: The end of a text, which no word can equal.
END = b""
_MARK = "▁".encode()


#: Longer words are broadcast as digests; what a broadcast word takes at most.
LONG, HOT_WORD = 64, 256
#: Words that a task counts before it hands them on, and bytes of them.
COUNT_WORDS, COUNT_BYTES = 300_000, 64 << 20


def short(word: bytes) -> bytes:
    """A key of at most LONG bytes; that of a long word holds a blank, as no word does."""
    return word if len(word) <= LONG else b" " + hashlib.blake2b(word, digest_size=16).digest()


def tokens(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z became a-z, then the end."""
    out = text.translate(LOWER).split()
    out.append(END)
    return out


def load_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces (as UTF-8, word starts marked; byte pieces as the byte) and prior log-probabilities of a sentencepiece file.

    Control and unknown pieces are left out; the last entry is the end of text.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        name = sp.id_to_piece(i)
        raw = bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.encode()
        if raw.startswith(_MARK) and raw.count(_MARK) > 1 or _MARK in raw[1:]:
            continue  # runs of spaces do not occur inside a word
        # A byte piece has no rank of its own: it comes after all others.
        rank = float(sp.get_piece_size()) if sp.is_byte(i) else -sp.get_score(i)
        pieces[raw] = min(rank, pieces.get(raw, rank))
    for b in range(256):
        pieces.setdefault(bytes([b]), float(sp.get_piece_size()))
    names = [*pieces, END]
    weight = np.array([1 / (2.7 + max(0.0, r)) for r in pieces.values()] + [1 / 300])
    return names, np.log(weight / weight.sum())


class Lattice:
    """All segmentations of a marked word into pieces, at their log-probabilities.

    A character that is no piece is spelled by its byte pieces.
    """

    _NOT_A_PREFIX, _PREFIX_ONLY = 1.0, 2.0  # beside log-probabilities, which are never positive

    def __init__(self, names: list[bytes], logp: np.ndarray):
        self.end, self.size = float(logp[-1]), len(names)
        self.bytes = {n[0]: (k, float(logp[k])) for k, n in enumerate(names[:-1]) if len(n) == 1}
        self.number: dict[str, int] = {}
        self.reach: dict[str, float] = {}
        for k, n in enumerate(names[:-1]):
            try:
                piece = n.decode()
            except UnicodeDecodeError:
                continue  # a byte piece
            self.number[piece] = k
            self.reach[piece] = float(logp[k])
            for size in range(1, len(piece)):
                self.reach.setdefault(piece[:size], self._PREFIX_ONLY)

    def _spelled(self, char: str) -> float:
        return sum(self.bytes[b][1] for b in char.encode())

    def log_marginal(self, word: bytes) -> float:
        """Natural log of the word's probability over all segmentations."""
        if word == END:
            return self.end
        text, get, exp, log = "▁" + word.decode(), self.reach.get, math.exp, math.log
        n = len(text)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for a in range(n):
            terms = into[a]
            if len(terms) == 1:
                base = terms[0]
            else:
                top = max(terms)
                base = top + log(sum([exp(t - top) for t in terms]))
            if get(text[a], 1.0) > 0:
                into[a + 1].append(base + self._spelled(text[a]))
            for b in range(a + 1, n + 1):
                p = get(text[a:b], 1.0)
                if p <= 0:
                    into[b].append(base + p)
                elif p == 1.0:
                    break
        top = max(into[n])
        return top + log(sum([exp(t - top) for t in into[n]]))

    def expect(self, word: bytes, times: float, into: dict[str, float]) -> None:
        """Adds ``times`` the expected number of each piece (or spelled character) in a segmentation of ``word``."""
        text, get, exp, log = "▁" + word.decode(), self.reach.get, math.exp, math.log
        n = len(text)
        edges: list[list[tuple[float, int, str]]] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        for a in range(n + 1):
            if a:
                terms = edges[a]
                if len(terms) == 1:
                    alpha[a] = terms[0][0]
                else:
                    top = max(terms)[0]
                    alpha[a] = top + log(sum([exp(t[0] - top) for t in terms]))
                if a == n:
                    break
            base = alpha[a]
            if get(text[a], 1.0) > 0:
                edges[a + 1].append((base + self._spelled(text[a]), a, text[a]))
            for b in range(a + 1, n + 1):
                piece = text[a:b]
                p = get(piece, 1.0)
                if p <= 0:
                    edges[b].append((base + p, a, piece))
                elif p == 1.0:
                    break
        share = [0.0] * n  # of all segmentations, those with a cut at each position
        share.append(times)
        for b in range(n, 0, -1):
            own = share[b]
            if own:
                terms = edges[b]
                if len(terms) == 1:
                    _, a, piece = terms[0]
                    share[a] += own
                    into[piece] += own
                else:
                    whole = alpha[b]
                    for t, a, piece in terms:
                        part = own * exp(t - whole)
                        share[a] += part
                        into[piece] += part

    def numbered(self, sums: dict[str, float], ends: float) -> np.ndarray:
        """Such sums, and the number of ends, by the vocabulary's order."""
        out = np.zeros(self.size)
        for piece, n in sums.items():
            k = self.number.get(piece)
            for at in [k] if k is not None else [self.bytes[x][0] for x in piece.encode()]:
                out[at] += n
        out[-1] = ends
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, c long (in training rows) of all rows' tokens; ``docs`` has text and train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rest = Counter(), set()
        for batch in small(batches):
            for text, train in zip(encoded(batch.column(0)), batch.column(1).to_pylist()):
                if train:
                    own.update(tokens(text))
                else:
                    rest.update(tokens(text))
            if len(own) + len(rest) > COUNT_WORDS or sum(map(len, own)) + sum(map(len, rest)) > COUNT_BYTES:
                yield out(own, rest)
                own, rest = Counter(), set()
        yield out(own, rest)

    def out(own: Counter, rest: set) -> pa.RecordBatch:
        more = [w for w in rest if w not in own]
        return pa.RecordBatch.from_arrays([pa.array([*own, *more], pa.binary()), pa.array([*own.values(), *[0] * len(more)], pa.int64())], names=["word", "n"])

    return docs.select("text", "train").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def adapted(words: DataFrame, names: list[bytes], prior: np.ndarray, strength: float) -> np.ndarray:
    """Log-probabilities from the pieces' expected counts over the training words, and the prior."""
    told = words.sparkSession.sparkContext.broadcast((names, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, found, ends = Lattice(*told.value), defaultdict(float), 0
        for batch in small(batches):
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w == END:
                    ends += c
                else:
                    lattice.expect(w, c, found)
        sums = lattice.numbered(found, ends)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.float64())], names=["piece", "n"])

    total = np.exp(prior) * strength
    # One row for each piece of the vocabulary at most.
    for k, n in words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
        total[k] += n
    return np.log(total / total.sum())


def score_documents(docs: DataFrame, vocabulary: str, train, id_col: str = "doc_id", text_col: str = "text", adapt: bool = True, strength: float = 10_000.0, word_edges: bool = True, hot_bytes: int = 48 << 20) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a condition on the columns of ``docs``.  base_score is the
    add-one unigram score over words; score the lattice's log10 probability.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    words = scratch.save(word_counts(rows), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    names, logp = load_vocabulary(vocabulary)
    if adapt and total:
        logp = adapted(words, names, logp, strength)
    model, hot = spark.sparkContext.broadcast((names, logp)), hot_bytes // HOT_WORD
    whole = total + distinct if word_edges and total else 0
    rest = math.log(distinct / whole) if whole else 0.0

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)

        def probability(word: bytes, c: int) -> float:
            p = lattice.log_marginal(word) + rest
            if whole and c:
                own = math.log(c / whole)
                p = max(p, own) + math.log1p(math.exp(-abs(p - own)))
            return p / math.log(10)

        for batch in small(batches):
            every = batch.column(0).to_pylist()
            p = list(map(probability, every, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(map(short, every), pa.binary())], names=["word", "c", "p", "key"])

    known = scratch.save(words.mapInArrow(marginals, "word binary, c long, p double, key binary"), "scored")
    scratch.drop(words)
    # Sixteen steps of counts an octave: a histogram of some hundred rows, whatever the corpus.
    step = F.floor(F.log2(F.col("c") + 1.0) * 16)
    least, held = None, 0
    for k, n in sorted(known.groupBy(step.alias("k")).agg(F.count("*")).collect(), reverse=True):
        if held + n > hot:
            break
        least, held = k, held + n
    top = known.where(step >= least).select("key", "c", "p").toPandas() if held else pd.DataFrame({"key": [], "c": [], "p": []})
    table_of = spark.sparkContext.broadcast({bytes(w): (math.log10(c + 1), p, c > 0) for w, c, p in zip(top["key"], top["c"].tolist(), top["p"].tolist())})

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row without word for each document, then one for each of its words that are not broadcast."""
        get, row = table_of.value.get, TaskContext.get().partitionId() << 36
        at, word, times = [], [], []
        for batch in small(batches):
            heads = []
            for doc, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                base = full = 0.0
                n = n_known = 0
                for w, k in Counter(tokens(text)).items():
                    n += k
                    hit = get(w if len(w) <= LONG else short(w))
                    if hit is None:
                        at.append(row)
                        word.append(w)
                        times.append(k)
                    else:
                        base += k * hit[0]
                        full += k * hit[1]
                        n_known += k * hit[2]
                heads.append((row, doc, n, n_known, base, full))
                row += 1
                if len(at) > 50_000:
                    yield pack(row=at, word=word, n=times)
                    at, word, times = [], [], []
            if heads:
                yield pack(**dict(zip(("row", "doc_id", "n", "n_known", "base", "full"), zip(*heads))))
        if at:
            yield pack(row=at, word=word, n=times)

    kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("full", pa.float64())]
    pack = lambda **own: pa.RecordBatch.from_arrays([pa.array(own[c], k) if c in own else pa.nulls(len(own["row"]), k) for c, k in kinds], names=[c for c, _ in kinds])
    parts = scratch.save(rows.select("doc_id", "text").mapInArrow(resolve, "row long, doc_id long, word binary, n long, n_known long, base double, full double"), "parts")
    rare = (
        parts.where("word is not null").select("row", "word", "n").join(known.select("word", "c", "p"), "word")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_base"), F.sum(F.col("n") * F.col("p")).alias("more_full"))
    )
    out = parts.where("word is null").join(rare, "row", "left")
    more = lambda c: F.coalesce(F.col(f"more_{c}"), F.lit(0))
    return out.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + more("known")).alias("n_known"),
        F.lit(int(total)).alias("train_tokens").cast("long"),
        (F.col("base") + more("base") - F.col("n") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("full") + more("full")).alias("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the lattice of the 32,000-piece vocabulary, learning from six sevenths of them."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    out = score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
