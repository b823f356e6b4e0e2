"""Sum-of-squares online packing of token streams into fixed windows.

A document's tokens (byte-level BPE ids, then an end id) come in one stream per
partition.  Whole windows are cut off a long document; the rest, and every
short document, is placed among the fill levels that still have room, and an
empty window: it goes to the level that leaves the smallest sum of squared
counts of partially filled windows.  The counts are a level array of
``window + 1`` entries, so the time for one placement does not depend on how
many documents came before.

At most ``most_open`` windows are open, whatever the lengths are: when one more
would be, and when a partition ends, the open windows are levelled, which takes
the emptiest apart and fills the fullest with their tokens, so that at most one
is not full.  That one stays open; at the end of a partition it is cut into
sequences of powers of two, which need no padding.  Nothing is shuffled; each
scan partition packs on its own, and its number is the high part of its
sequence ids.

Defined cases: a null or empty text is the end id alone; a text of any length,
with white-space runs of any length, is encoded whole; the strings of the
vocabulary's special tokens become these tokens, as ``tokenizers`` has it;
equal documents and repeated doc_ids are packed as often as they occur; a null
doc_id stays null; an empty table gives no rows.  Columns other than the id and
the text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, small, table

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Rows of one output batch.
BATCH = 2048
#: Windows that are open at once; with 1024 ids each they take 16 MB.
MOST_OPEN = 4096


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


#: Runs of white space from this length on do not reach the splitting pattern, whose backtracking is bounded (a run of 1,000,000 overflows it).
LONG_RUN = 100_000
# Unicode's White_Space, which is \s in both encoders, but not in Python.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

_ENCODERS: dict[str, Callable[[list[str]], list[list[int]]]] = {}


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """``make_encoder``, once for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = make_encoder(path)
    return _ENCODERS[path]


def make_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file by ``encode(text, add_special_tokens=False)``.

    The file's vocabulary is merged by tiktoken, which gives the same ids in a
    quarter of the time.  Whether it does is compared with ``tokenizers`` itself
    on the first texts of each worker, and any difference ends the task.
    The text is cut at the strings of special tokens, each of which is its own id;
    where a vocabulary has special tokens that also take what is around them, and
    where the fast encoder gives up, ``tokenizers`` encodes the text.
    A long run of white space is one piece of the pattern, but for its last
    character where more text follows; it is cut out and merged as such.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    special = {x["content"]: x["id"] for x in added}
    plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in added)
    cuts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    to_byte = byte_alphabet()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in own.get_vocab().items() if token not in special}
    # The pattern that byte-level BPE files of this family split by.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    compare: list[Tokenizer] = [own]

    def slow(text: str) -> list[int]:
        return (compare[0] if compare else Tokenizer.from_file(path)).encode(text, add_special_tokens=False).ids

    def between(text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if len(text) < LONG_RUN or not (runs := [m.span() for m in _LONG_RUN.finditer(text)]):
            return fast.encode_ordinary(text)
        out, done = [], 0
        for first, past in runs:
            past -= past < len(text)
            out += fast.encode_ordinary(text[done:first])
            out += fast._encode_single_piece(text[first:past])
            done = past
        return out + fast.encode_ordinary(text[done:])

    def ids(text: str) -> list[int]:
        parts = cuts.split(text) if cuts else [text]
        try:
            if len(parts) == 1:
                return between(text)
            if plain:
                return [i for k, part in enumerate(parts) for i in ([special[part]] if k % 2 else between(part))]
        except Exception as gave_up:  # noqa: BLE001  whatever the fast encoder can't do the slow one does
            del gave_up
        return slow(text)

    def encode(texts: list[str]) -> list[list[int]]:
        out = [ids(t) for t in texts]
        if compare and texts:
            for t in texts[:8]:
                if slow(t[:20_000]) != ids(t[:20_000]):
                    raise ValueError("the two encoders differ on this vocabulary")
            compare.clear()  # and with it its memory
        return out

    return encode


class SumOfSquares:
    """Windows of ``size`` tokens that are filled online; ``place`` returns those that became full."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def level_for(self, n: int) -> int:
        """The level, 0 for a new window, that minimises the sum of squares after ``n`` tokens go there."""
        count, size = self.count, self.size
        levels = np.arange(0, size - n + 1)
        # Moving one window from level h to h+n changes the sum by 2(N[h+n] - N[h]) + 2;
        # opening one by 2 N[n] + 1; a window that fills leaves the sum by 2 N[h] - 1.
        change = 2 * count[n : size + 1] - 2 * count[: size - n + 1] + 2
        change[0] = 2 * count[n] + 1
        change[-1] = -2 * count[size - n] + 1 if n < size else 0
        free = count[: size - n + 1] > 0
        free[0] = True
        change = np.where(free, change, np.iinfo(np.int64).max)
        best = np.flatnonzero(change == change.min())
        return int(levels[best[-1]])  # of equals the fullest

    def place(self, piece: list, n: int) -> list | None:
        h = self.level_for(n)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
        else:
            window = []
        window.append(piece)
        if h + n == self.size:
            return window
        self._put(window, h + n)
        return None

    def _put(self, window: list, level: int) -> None:
        self.open[level].append(window)
        self.count[level] += 1

    def level(self) -> Iterator[list]:
        """The open windows, levelled: all are full but one, which stays open.  A piece is [doc, start, ids, doc_tokens]."""
        rest = [w for level in range(self.size, 0, -1) for w in self.open[level]]
        self.count[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        low = len(rest) - 1
        for high, window in enumerate(rest):
            if high > low:
                break
            room = self.size - sum(len(p[2]) for p in window)
            while room and low > high:
                doc, start, ids, total = rest[low].pop()
                if len(ids) > room:
                    window.append([doc, start, ids[:room], total])
                    rest[low].append([doc, start + room, ids[room:], total])
                    room = 0
                else:
                    window.append([doc, start, ids, total])
                    room -= len(ids)
                if not rest[low]:
                    low -= 1
            if room:
                self._put(window, self.size - room)
            else:
                yield window

    def finish(self) -> Iterator[list]:
        """What is left at the end: full windows, and sequences of powers of two of the last."""
        yield from self.level()
        for level in np.flatnonzero(self.count).tolist():
            for left in self.open[level]:
                for size in (1 << k for k in range(level.bit_length() - 1, -1, -1) if level >> k & 1):
                    part, room = [], size
                    while room:
                        doc, start, ids, total = left.pop(0)
                        if len(ids) > room:
                            left.insert(0, [doc, start + room, ids[room:], total])
                        part.append([doc, start, ids[:room], total])
                        room -= len(part[-1][2])
                    yield part
        self.count[:] = 0
        self.open = [[] for _ in range(self.size + 1)]


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces of the packed windows: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base, made, bins = TaskContext.get().partitionId() << 36, 0, SumOfSquares(window)
        rows: list[tuple] = []

        def emit(pieces: list) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), total, base + made, at))
                at += len(ids)
            made += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()
            return out

        for batch in small(batches):
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(texts), 64):
                part = [x or "" for x in texts[a : a + 64].to_pylist()]
                for doc, tokens in zip(ids_of[a : a + 64], encode(part)):
                    tokens.append(end_id)
                    ids = np.array(tokens, "<u4")
                    n, at = len(ids), 0
                    while n - at >= window:
                        emit([[doc, at, ids[at : at + window], n]])
                        at += window
                    if at < n and (full := bins.place([doc, at, ids[at:].copy(), n], n - at)):
                        emit(full)
                    if bins.count.sum() > most_open:
                        for pieces in bins.level():
                            emit(pieces)
                if len(rows) >= BATCH:
                    yield flush()
        for pieces in bins.finish():
            emit(pieces)
            if len(rows) >= BATCH:
                yield flush()
        if rows:
            yield flush()

    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 ids; the ids are replaced by their CRC-32."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
