"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items make one automaton, whose states stand
for the word sequences that occur in some item.  A document's words are
streamed through it; the state and the longest matching length are tracked, and
a match of ``window`` words or more (or of a whole shorter item) marks its words
as hit.  Spans that are long enough are cut from the text, and documents of
which more than a given share is hit are dropped.

Items are taken in blocks of at most ``max_words`` words.  Executors build the
blocks' automata and write them to the shared folder as flat arrays (edges sorted
by state and word); nothing of the items passes through the driver but the names
of the blocks.  Workers map these arrays into memory, so that a block costs a
machine its size once, about 80 bytes a word.  An item of more than ``max_words``
words is cut into pieces that overlap by a window less a word, so no block is
larger.  All blocks are scanned in one pass over the documents.

Words are compared by 64-bit hashes.  Only runs of words that a block knows reach
its automaton; long runs are walked in chunks at once, each beginning a window less
a word early, which finds the same matches of window length.

Defined cases: a null text has no words and stays null; a text of any length is
scanned whole; an item of a null or empty text has no windows; an item without an id
has none either, unless ``nameless`` is given: then it hits as any other and is left
out of the ids alone; repeated items and documents count as often as they occur,
item ids as a set; with no items nothing is hit; an empty table gives no rows.
Columns that ``scan`` adds replace those of the same names; ``remove_spans`` returns
the columns that it was given, whatever they are called.
"""

from __future__ import annotations

import io
import re
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import LOWER, Scratch, encoded, free_name, hashed_texts, small, table, word_table
from .stores import open_store

#: ASCII that is no part of a word, after A-Z are lower-cased.
BREAKS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_NORMAL = bytearray(LOWER)
for _b in BREAKS:
    if not 65 <= _b <= 90:
        _NORMAL[_b] = 32
_NORMAL = bytes(_NORMAL)
_WORD = re.compile(rb"[^\x20]+")
#: The same for hashing.
WORDS = word_table(bytes(b for b in BREAKS if not 65 <= b <= 90))


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z."""
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """Of several sequences of word codes; ``items`` are (place of the item's name or -1, codes)."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [0], [0]
        for _, seq in items:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self._label(items)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _redirect(self, p: int, c: int, old: int, new: int) -> None:
        """From ``p`` up, edges by ``c`` to ``old`` go to ``new``."""
        while self.next[p].get(c) == old:
            self.next[p][c] = new
            if not p:
                return
            p = self.link[p]

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the sequences that end by ``c`` after ``p``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self._redirect(p, c, q, copy)
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item has this sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while c not in self.next[p]:
            self.next[p][c] = new
            if not p:
                return new
            p = self.link[p]
        q = self.next[p][c]
        self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _walk(self, seq: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word of an own sequence."""
        v = size = 0
        for c in seq:
            while c not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            v = self.next[v][c]
            size += 1
            yield v, size

    def _label(self, items: list[tuple[int, list[int]]]) -> None:
        """For states of window length the items; for whole shorter items their length."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.at = [-1] * len(self.length)  # the state on the suffix path that holds sequences of window length
        for v in order:
            self.at[v] = v if self.length[v] >= self.window > self.length[self.link[v]] else self.at[self.link[v]]
        held: set[tuple[int, int]] = set()  # state, item
        short: set[tuple[int, int, int]] = set()  # state, length, item
        for name, seq in items:
            if len(seq) >= self.window:
                held.update((self.at[v], name) for v, size in self._walk(seq) if size >= self.window)
                continue
            v = 0
            for c in seq:
                v = self.next[v][c]
            short.add((v, len(seq), name))
        self.held, self.short = sorted(held), sorted(short)
        own = [0] * len(self.length)  # the longest such item of a state, and of those above it
        for v, size, _ in self.short:
            own[v] = max(own[v], size)
        above = [0] * len(self.length)
        for v in order:
            above[v] = max(above[self.link[v]], own[self.link[v]])
        self.own, self.above = own, above

    def arrays(self) -> dict[str, np.ndarray]:
        """The automaton flat; ``Block`` reads it."""
        edges = sorted((v << 32 | c, t) for v, out in enumerate(self.next) for c, t in out.items())
        small_ints = lambda x: np.array(x, np.int32)
        return {
            "keys": np.array([k for k, _ in edges], np.int64),
            "targets": small_ints([t for _, t in edges]),
            **{name: small_ints(getattr(self, name)) for name in ("link", "length", "at", "own", "above")},
            "held": small_ints(self.held).reshape(-1, 2),
            "short": small_ints(self.short).reshape(-1, 3),
        }


_ARRAYS = ("keys", "targets", "link", "length", "at", "own", "above", "held", "short", "known", "name_bytes", "name_ends")
#: Words of a run that are walked one after the other; runs are walked at once.
CHUNK = 64


class Block:
    """A block's automaton, as it lies in the shared folder."""

    def __init__(self, arrays: dict[str, np.ndarray], window: int):
        self.a, self.window = arrays, window
        self.least = min([window, *np.unique(arrays["short"][:, 1]).tolist()])

    @classmethod
    def build(cls, items: list[tuple[str | None, np.ndarray]], window: int) -> dict[str, np.ndarray]:
        """The arrays of a block of items (name, word hashes)."""
        known = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        names = sorted({n for n, _ in items if n is not None})
        place = {n: k for k, n in enumerate(names)}
        automaton = SuffixAutomaton([(-1 if n is None else place[n], np.searchsorted(known, h).tolist()) for n, h in items], window)
        raw = [n.encode() for n in names]
        return automaton.arrays() | {"known": known, "name_bytes": np.frombuffer(b"".join(raw), np.uint8), "name_ends": np.cumsum([len(r) for r in raw], dtype=np.int64)}

    def _name(self, k: int) -> str:
        ends = self.a["name_ends"]
        return bytes(self.a["name_bytes"][ends[k - 1] if k else 0 : ends[k]]).decode()

    def _walk(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and matching length after each word; ``codes`` is -1 where no item has the word."""
        state, size = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int32)
        edge = np.diff((codes >= 0).astype(np.int8), prepend=0, append=0)
        first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        some = past - first >= self.least
        first, past = first[some], past[some]
        parts = -(-(past - first) // CHUNK)
        run = np.repeat(np.arange(len(first)), parts)
        own = first[run] + (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
        stop, pos = np.minimum(own + CHUNK, past[run]), np.maximum(first[run], own - (self.window - 1))
        v, n = np.zeros(len(run), np.int64), np.zeros(len(run), np.int32)
        keys, targets, link, length = (self.a[k] for k in ("keys", "targets", "link", "length"))
        live = np.arange(len(run))
        while len(live):
            key = v[live] << 32 | codes[pos[live]]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            goes = keys[k] == key
            on, back = live[goes], live[~goes]
            v[on] = targets[k[goes]]
            n[on] += 1
            p = pos[on]
            told = p >= own[on]
            state[p[told]], size[p[told]] = v[on[told]], n[on[told]]
            pos[on] += 1
            v[back] = link[v[back]]  # the first state has an edge for every known word
            n[back] = length[v[back]]
            live = live[pos[live] < stop[live]]
        return state, size

    def scan(self, hashes: np.ndarray, at: np.ndarray, hit: np.ndarray, found: list[set[str]]) -> None:
        """Marks in ``hit`` the hit words, and adds to ``found`` the items that occur, of texts whose words begin at ``at``."""
        known = self.a["known"]
        if not len(known) or not len(hashes):
            return
        codes = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        codes = np.where(known[codes] == hashes, codes, -1)
        ends = np.zeros(len(hashes) + 1, bool)
        ends[at[:-1]] = True
        cut = np.flatnonzero(ends[:-1])
        # A word that is in no item between texts, so that no run goes over.
        place = np.arange(len(hashes)) + np.cumsum(ends[:-1])
        spaced = np.full(len(hashes) + len(cut), -1, np.int64)
        spaced[place] = codes
        state, size = (x[place] for x in self._walk(spaced))
        text = np.searchsorted(at, np.arange(len(hashes)), "right") - 1 if len(self.a["keys"]) else None
        whole = size >= self.window
        reach = np.where(whole, self.window, 0)
        if len(self.a["short"]):
            shorter = np.where(size > 0, self.a["above"][state], 0)
            own = self.a["own"][state]
            shorter = np.where((own > 0) & (own <= size), own, shorter)
            for k in np.flatnonzero(own > size).tolist():  # a state's longest item may be longer than the match
                shorter[k] = max([shorter[k], *(n for n, _ in self._short(int(state[k])) if n <= size[k])])
            for k, v, n in np.unique(np.stack([text, state, size], 1)[shorter > 0], axis=0).tolist():
                while v:
                    found[k].update(self._name(i) for m, i in self._short(v) if m <= n and i >= 0)
                    v = int(self.a["link"][v])
            reach = np.maximum(reach, shorter)
        for k, v in np.unique(np.stack([text, self.a["at"][state]], 1)[whole], axis=0).tolist():
            found[k].update(self._name(i) for i in self._held(v) if i >= 0)
        end = np.flatnonzero(reach)
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, end + 1 - reach[end], 1)
        np.add.at(cover, end + 1, -1)
        hit |= np.cumsum(cover[:-1]) > 0

    def _held(self, v: int) -> list[int]:
        rows = self.a["held"]
        return rows[np.searchsorted(rows[:, 0], v) : np.searchsorted(rows[:, 0], v, "right"), 1].tolist()

    def _short(self, v: int) -> list[list[int]]:
        rows = self.a["short"]
        return rows[np.searchsorted(rows[:, 0], v) : np.searchsorted(rows[:, 0], v, "right"), 1:].tolist()


_BLOCKS: OrderedDict[str, Block] = OrderedDict()
#: Blocks that a worker keeps open; where they can't be mapped these are held in memory.
MOST_OPEN = 16


def open_block(at: str, window: int) -> Block:
    """The block whose arrays lie in the folder ``at``."""
    if at not in _BLOCKS:
        store, path = open_store(at)
        if isinstance(store, fs.LocalFileSystem):
            read = lambda name: np.load(f"{path}/{name}.npy", mmap_mode="r")
        else:
            read = lambda name: np.load(io.BytesIO(store.open_input_stream(f"{path}/{name}.npy").read()))
        _BLOCKS[at] = Block({name: read(name) for name in _ARRAYS}, window)
        while len(_BLOCKS) > MOST_OPEN:
            _BLOCKS.popitem(last=False)
    _BLOCKS.move_to_end(at)
    return _BLOCKS[at]


def build_blocks(benchmark: DataFrame, scratch: Scratch, window: int, id_col: str = "item_id", text_col: str = "text", max_words: int = 200_000, nameless: bool = False) -> list[str]:
    """Folders of the automata over all items, built by the executors; items without an id only where ``nameless``."""
    folder = scratch.path("blocks")

    def build(items: list[tuple[str | None, np.ndarray]]) -> str:
        store, path = open_store(folder)
        own = uuid.uuid4().hex  # of this attempt; the blocks of attempts that failed are not named to anyone
        store.create_dir(f"{path}/{own}", recursive=True)
        for name, array in Block.build(items, window).items():
            held = io.BytesIO()
            np.save(held, array)
            with store.open_output_stream(f"{path}/{own}/{name}.npy", compression=None) as out:
                out.write(held.getbuffer())
        return f"{folder}/{own}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([build(block)], pa.string())], names=["block"])
        for batch in small(batches):
            names, texts = batch.column(0).to_pylist(), encoded(batch.column(1))
            for first, _, hashes, at in hashed_texts(texts, WORDS):
                for k in range(len(at) - 1):
                    words_of = hashes[at[k] : at[k + 1]]
                    step = max(1, max_words - window + 1)
                    # The last piece has a window at least, where the item has.
                    for a in range(0, max(1, len(words_of) - window + 1), step):
                        piece = words_of[a : a + step + window - 1]
                        if block and held + len(piece) > max_words:
                            yield done()
                            block, held = [], 0
                        if len(piece):
                            block.append((names[first + k], piece))
                            held += len(piece)
        if block:
            yield done()

    items = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    if not nameless:
        items = items.where("name is not null")
    # As few tasks as there are blocks, of about five letters a word.
    letters = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return [r[0] for r in items.coalesce(max(1, -(-int(letters) // (6 * max_words)))).mapInArrow(run, "block string").collect()]


_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
ADDED = ("dc_n_words", "dc_spans", "dc_items")
_KINDS = ((T.LongType(), pa.int64()), (_SPANS, pa.list_(pa.list_(pa.int32()))), (T.ArrayType(T.StringType()), pa.list_(pa.string())))


Then = Callable[[pa.RecordBatch], pa.RecordBatch]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", max_words: int = 200_000, then: Then | None = None, nameless: bool = False, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with the number of words, the spans of hit words ([first, past) each) and the items that occur (ids as strings, sorted).

    ``names`` are those of the three columns.  ``then`` is applied to the batches, in the same Python worker.
    """
    spark = docs.sparkSession
    blocks = build_blocks(benchmark, Scratch(spark, "decontamination"), window, max_words=max_words, nameless=nameless)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            own = batch.schema.names
            sizes, spans, items = [], [], []
            for _, _, hashes, at in hashed_texts(encoded(batch.column(own.index(text_col))), WORDS):
                hit, found = np.zeros(len(hashes), bool), [set() for _ in range(len(at) - 1)]
                for block in blocks:
                    open_block(block, window).scan(hashes, at, hit, found)
                sizes += np.diff(at).tolist()
                spans += _runs(hit, at)
                items += [sorted(x) for x in found]
            kept = [(n, c) for n, c in zip(own, batch.columns) if n not in names]
            more = [(c, pa.array(v, kind)) for c, (_, kind), v in zip(names, _KINDS, (sizes, spans, items))]
            out = pa.RecordBatch.from_arrays([c for _, c in [*kept, *more]], names=[n for n, _ in [*kept, *more]])
            yield then(out) if then else out

    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in names), *(T.StructField(c, t) for c, (t, _) in zip(names, _KINDS))])
    return docs.drop(*names).mapInArrow(run, schema)


def _runs(hit: np.ndarray, at: np.ndarray) -> list[list[list[int]]]:
    """Spans [first, past) of hit words of each text."""
    out: list[list[list[int]]] = [[] for _ in range(len(at) - 1)]
    if hit.any():
        texts = np.searchsorted(at, np.flatnonzero(hit), "right") - 1
        for k in np.unique(texts).tolist():
            edge = np.diff(hit[at[k] : at[k + 1]].astype(np.int8), prepend=0, append=0)
            out[k] = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist()
    return out


def _cutter(text_col: str, least: int, max_coverage: float, names: tuple[str, str, str]) -> Then:
    """Drops texts that are hit beyond ``max_coverage``; of others it cuts the bytes from the first to the last word of each span of ``least`` words or more."""

    def cut(text: str | None, spans: list[list[int]]) -> str | None:
        spans = [s for s in spans if s[1] - s[0] >= least]
        if text is None or not spans:
            return text
        raw = text.encode()
        at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
        out, done = [], 0
        for first, past in spans:
            out.append(raw[done : at[first][0]])
            done = at[past - 1][1]
        return b"".join([*out, raw[done:]]).decode()

    def then(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.schema.names
        k, spans = own.index(text_col), batch.column(own.index(names[1])).to_pylist()
        hits = (sum(b - a for a, b in x) for x in spans)
        stay = [h <= n * max_coverage for h, n in zip(hits, batch.column(own.index(names[0])).to_pylist())]
        texts = [cut(t, x) if y else None for t, x, y in zip(batch.column(k).to_pylist(), spans, stay)]
        return batch.set_column(k, text_col, pa.array(texts, batch.schema.field(k).type)).filter(pa.array(stay, pa.bool_()))

    return then


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, least_words: int = 10, max_coverage: float = 0.5, text_col: str = "text", count_col: str | None = "n_chars", max_words: int = 200_000, nameless: bool = False) -> DataFrame:
    """``docs`` without hit spans of ``least_words`` or more, and without documents hit beyond ``max_coverage`` of their words.

    A shorter item that occurs whole counts as a hit; it is cut where it has
    ``least_words`` words.  ``count_col``, where the table has it, is set anew
    for texts that were cut.
    """
    names = tuple(free_name(c, docs.columns) for c in ADDED)
    cut = scan(docs, benchmark, window, text_col, max_words, _cutter(text_col, least_words, max_coverage, names), nameless, names)
    touched = F.exists(names[1], lambda s: s[1] - s[0] >= least_words)
    if count_col and count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        cut = cut.withColumn(count_col, F.when(touched, F.length(text_col).cast(kind)).otherwise(F.col(count_col)))
    return cut.select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every benchmark window of ten words in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"), nameless=True)
    n_hit = F.aggregate("dc_spans", F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]).cast("long"))
    return found.select(
        "doc_id",
        F.col("dc_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
