"""MinHash near-duplicates: many universal hash minima, banding, signature
verification, and connected components by alternating large-star and small-star.

1. Each text's words become a set of distinct shingles; texts with equal sets are
   one class from here on, so that copies cost one row.
2. Of each class 128 minima of universal hashes are taken, and cut into 32 bands of
   4.  Classes that agree in a band share a bucket.  A pair at the threshold of 0.8
   misses all buckets with a likelihood of (1 - 0.8**4)**32 < 5e-8.
3. In each bucket every member is paired with one leader, another in each bucket of
   the same documents: a row for a member, never all pairs.  A pair's signatures and
   set sizes are compared, and what may reach the threshold is confirmed on the full
   sets.  The confirmed links' components follow.
4. A bucket whose members are in one component is done.  In the others each member
   outside the bucket's largest component is to be compared with all members of other
   components, in blocks of such members against members.  First by signatures: a row
   of a block is a document's size and a longer signature of 512 minima, and what comes
   back is which members have any partner that may reach the threshold, a row each at
   most.  Texts that share boilerplate part here, and their sets are never shipped.
5. Members that have such partners meet once more in smaller blocks, now with their
   full sets.  A block streams its members past those that it holds, confirms links on
   the sets, skips pairs that are tied already, and returns a spanning forest of the
   components alone.  Buckets of the same members are taken once.  There is no cap:
   every pair that shares a bucket is either compared or known to be in one component.

Sets below ``least`` shingles can only be linked to equal sets, and are left out
of the banding.

Defined cases: null and empty texts, and those without words, have an empty set and
are linked with nothing; a text with fewer words than a shingle has its whole
sequence as one; rows that repeat a doc_id are one document, and share its
component; a row without a doc_id is kept, with a null component; a very long text
is hashed in pieces that end at separators, and its whole set is compared; an empty
table gives no rows.  Columns the operator adds start with ``nd_`` and replace those of
that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, encoded, free_name, hashed_texts, mix, small, table
from .components import connected_components

HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
#: Minima of the longer signatures, of which the first are those of the bands.
LONG = 512
#: Members of a block of signatures: those that are held, and those that stream past them.
SIGNED_LEFT, SIGNED_RIGHT = 512, 512
#: The same for blocks of full sets.
LEFT, RIGHT = 256, 512
_U64 = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
#: Universal hashes x -> (a x + b) >> 32 of 64-bit values, a odd.
_A = _RANDOM.integers(0, 2**63, LONG, dtype=np.uint64) * _U64(2) + _U64(1)
_B = _RANDOM.integers(0, 2**63, LONG, dtype=np.uint64)
#: Agreeing minima (of 8 bits) that a pair at the threshold t falls below once in 10**8: mean less 5.7 deviations.
DEVIATIONS = 5.7


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, words, at in hashed_texts(texts):
        step = np.full(len(words), _U64(0))
        n = len(words)
        if n >= size:
            grams = words[: n - size + 1].copy()
            for k in range(1, size):
                grams = mix(grams * _U64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k])
            step[: len(grams)] = grams
        for k in range(b - a):
            first, past = int(at[k]), int(at[k + 1])
            if past - first >= size:
                yield np.unique(step[first : past - size + 1])
            elif past > first:
                h = mix(words[first : first + 1] ^ _U64(past - first))
                for w in words[first + 1 : past]:
                    h = mix(h * _U64(0x9E3779B97F4A7C15) + w)
                yield h
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, count: int = HASHES) -> np.ndarray:
    """The first ``count`` minima, of 32 bits; ``shingles`` is not empty."""
    out = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    step = 2048 * HASHES // count
    for k in range(0, len(shingles), step):  # a block of 2 MB
        part = (shingles[k : k + step, None] * _A[:count] + _B[:count]) >> _U64(32)
        np.minimum(out, part.min(0).astype(np.uint32), out=out)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = mix(h * _U64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; 0, 0 for the empty one."""
    one = np.add.reduce(mix(shingles ^ _U64(0xA0761D6478BD642F)))
    two = np.bitwise_xor.reduce(mix(shingles ^ _U64(0xE7037ED1A0B428DB)))
    return int(np.int64(one.view(np.int64))), int(np.int64(two.view(np.int64)))


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])


def sketches(docs: DataFrame, size: int, least: int) -> DataFrame:
    """doc_id, n, k1, k2 (the set's size and key), bands and an 8-bit signature (null below ``least``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for doc, shingles in zip(batch.column(0).to_pylist(), shingle_sets(encoded(batch.column(1)), size)):
                own = minima(shingles) if len(shingles) >= least else None
                rows.append((doc, len(shingles), *set_key(shingles), None if own is None else bands(own), None if own is None else own.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _SKETCH)] if rows else [pa.array([], k.type) for k in _SKETCH], schema=_SKETCH)

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, signature binary")


def full_sets(docs: DataFrame, size: int, signed: bool = False) -> DataFrame:
    """node, n, shingles of texts that have any, and where ``signed`` the long signature."""
    kinds = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64())), *([("signature", pa.binary())] if signed else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [(d, len(s), s.view(np.int64), *([minima(s, LONG).astype(np.uint8).tobytes()] if signed else [])) for d, s in zip(batch.column(0).to_pylist(), shingle_sets(encoded(batch.column(1)), size)) if len(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

    return docs.mapInArrow(run, "node long, n long, shingles array<long>" + (", signature binary" if signed else ""))


def _agreements(percent: int, count: int = HASHES) -> int:
    """Agreeing minima of ``count`` below which a pair at the threshold hardly ever falls."""
    t = percent / 100
    return int(count * t - DEVIATIONS * (count * t * (1 - t)) ** 0.5)


def components(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component`` of each row of ``docs(doc_id, text)``.

    ``percent``: two sets are linked if 100 * |both| >= percent * |either|.
    """
    # Two different sets of fewer shingles than this stay below the threshold.
    least = max(1, -(-percent // (100 - percent))) if percent < 100 else 1
    sketched = scratch.save(sketches(docs, size, least), "sketches")
    named = sketched.where("doc_id is not null and n > 0")
    classes = scratch.save(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes")
    heads = scratch.save(
        named.where("bands is not null").join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("node"), "n", "bands", "signature"), "heads"
    )
    signed = heads.select("node", "n", "signature")
    members = heads.select("node", F.explode("bands").alias("bucket"))
    leader = F.min(F.struct(F.xxhash64("node", "bucket"), "node"))["node"]
    shared = scratch.save(members.groupBy("bucket").agg(F.count("*").alias("m"), leader.alias("leader")).where("m > 1"), "shared")
    inside = scratch.save(members.join(shared, "bucket").select("bucket", "node", "leader", "m"), "inside")
    scratch.drop(shared)

    # Stars: each member against its bucket's leader.
    star = scratch.save(inside.where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "star")
    likely = scratch.save(_likely(star, signed, percent), "likely")
    scratch.drop(star)
    # The texts of likely pairs are read once more, for their sets.
    of_nodes = lambda nodes, name: docs.join(scratch.save(nodes.distinct(), name), F.col("doc_id") == F.col("node"), "left_semi")
    sets = scratch.save(full_sets(of_nodes(likely.select(F.explode(F.array("a", "b")).alias("node")), "wanted"), size), "sets")
    # A document with several texts ties their classes together.
    named_class = named.select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")
    of_doc = scratch.save(named_class.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select(F.col("doc_id").alias("several")), "several")
    ties = named_class.join(of_doc, F.col("doc_id") == F.col("several"), "left_semi").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = scratch.save(_confirmed(likely, sets, percent).union(ties).distinct(), "links")
    found = scratch.save(connected_components(links, scratch), "found")
    scratch.drop(likely, sets)

    # Buckets of three or more members that are not all in one component.
    placed = scratch.save(inside.where("m > 2").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed")
    scratch.drop(inside)
    mine = classes.join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    rest = scratch.save(_mixed(placed, scratch), "rest")
    if not rest.isEmpty():
        sets = scratch.save(full_sets(of_nodes(rest.select("node"), "mixed-nodes"), size, signed=True), "signed-sets")
        near = scratch.save(_near(rest, sets.select("node", "n", "signature"), percent, scratch).distinct(), "near")
        some = scratch.save(rest.join(near, ["bucket", "node"], "left_semi"), "some")
        ties = scratch.save(_blocks(some, sets, percent, scratch).distinct(), "ties")
        merged = scratch.save(connected_components(ties, scratch).select(F.col("node").alias("component"), F.col("component").alias("whole")), "merged")
        scratch.drop(sets, near, some)
        mine = mine.join(merged, "component", "left").select("k1", "k2", F.coalesce("whole", "component").alias("component"))
    scratch.drop(placed, rest)
    of_class = scratch.save(mine, "of-class")
    rows = sketched.select("doc_id", "n", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def _likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes and signatures allow the threshold."""
    both = pairs.join(signed.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")), "b").join(signed.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a")
    close = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    enough = _agreements(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((one == two).sum(1) >= enough))

    return close.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (with their other columns) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select(*pairs.columns)


def _mixed(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, node, component, few: members of buckets that are not all in one component; ``few`` is outside the largest."""
    sizes = scratch.save(placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("of"), F.min("node").alias("first"), F.max("node").alias("last")), "sizes")
    largest = F.max(F.struct("n", "component"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("m"), F.bit_xor("of").alias("of"), F.min("first").alias("first"), F.max("last").alias("last"), largest["component"].alias("main"), largest["n"].alias("most")).where("m > most")
    once = mixed.groupBy("m", "of", "first", "last").agg(F.min(F.struct("bucket", "main")).alias("x")).select("x.bucket", "x.main")
    return placed.join(scratch.save(once, "mixed"), "bucket").select("bucket", "node", "component", (F.col("component") != F.col("main")).alias("few"))


def _dealt(rest: DataFrame, carried: DataFrame, left: int, right: int, scratch: Scratch) -> DataFrame:
    """Rows of blocks (bucket, x, y), sorted: first those that are held (part 0), then those that pass (part 1).

    The few members of a bucket are dealt over parts of about ``left``, all its
    members over parts of about ``right``; each left part meets each right part.
    """
    size = rest.groupBy("bucket").agg(F.count("*").alias("m"), F.count(F.when(F.col("few"), 1)).alias("f"))
    size = size.where("f > 0 and m > 1").select("bucket", F.ceil(F.col("f") / left).alias("lefts"), F.ceil(F.col("m") / right).alias("rights"))
    # Both sides come from files: small sizes are broadcast and move no row, and else a large bucket is split at run time.
    whole = rest.join(scratch.save(size, "block-sizes"), "bucket")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    held = whole.where("few").withColumn("y", F.explode(upto("rights"))).select("bucket", own("lefts").alias("x"), "y", F.lit(0).alias("part"), "node", "component", "few")
    passing = whole.withColumn("x", F.explode(upto("lefts"))).select("bucket", "x", own("rights").alias("y"), F.lit(1).alias("part"), "node", "component", "few")
    return held.union(passing).join(carried, "node").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "part", "node")


class _Block:
    """Members that are held, and which of them may reach the threshold with one that passes, by size and signature."""

    def __init__(self, bucket: int, percent: int):
        self.bucket, self.percent = bucket, percent
        self.enough = _agreements(percent), _agreements(percent, LONG)
        self.rows: list[tuple] = []
        self.ready = False

    def hold(self, node: int, component: int, few: bool, size: int, sign: bytes, *more) -> None:
        self.rows.append((node, component, size, sign, *(x.copy() for x in more)))

    def start(self) -> None:
        self.ready = True
        nodes, components, sizes, signs, *self.more = zip(*self.rows) if self.rows else ((), (), (), (), ())
        self.nodes, self.components, self.sizes = (np.array(x, np.int64) for x in (nodes, components, sizes))
        self.signs = np.frombuffer(b"".join(signs), np.uint8).reshape(-1, LONG)
        self.heads = np.ascontiguousarray(self.signs[:, :HASHES])
        self.rows = []

    def partners(self, node: int, component: int, few: bool, size: int, sign: bytes) -> np.ndarray:
        """Places of the held members that may be linked to this one."""
        if not self.ready:
            self.start()
        other = (self.components != component) & (100 * np.minimum(self.sizes, size) >= self.percent * np.maximum(self.sizes, size))
        if few:  # both sides are held somewhere; one of them compares
            other &= self.nodes < node
        at = np.flatnonzero(other)
        own = np.frombuffer(sign, np.uint8)
        at = at[(self.heads[at] == own[:HASHES]).sum(1) >= self.enough[0]]
        return at[(self.signs[at] == own).sum(1) >= self.enough[1]] if len(at) else at


class _Signed(_Block):
    """Which members have any partner."""

    def __init__(self, *args):
        super().__init__(*args)
        self.out: list[tuple] = []
        self.named: set[int] = set()

    def meet(self, node: int, *row) -> None:
        at = self.partners(node, *row)
        if len(at):
            self.out += [(self.bucket, n) for n in (node, *self.nodes[at].tolist()) if n not in self.named]
            self.named.update(n for _, n in self.out[-len(at) - 1 :])


class _Full(_Block):
    """Links between components, confirmed on full sets, of a spanning forest."""

    def __init__(self, *args):
        super().__init__(*args)
        self.out: list[tuple] = []
        self.of: dict[int, int] = {}

    def root(self, c: int) -> int:
        of = self.of
        of.setdefault(c, c)
        while of[c] != c:
            of[c] = of[of[c]]
            c = of[c]
        return c

    def meet(self, node: int, component: int, few: bool, size: int, sign: bytes, shingles: np.ndarray) -> None:
        for k in self.partners(node, component, few, size, sign).tolist():
            p, q = self.root(int(self.components[k])), self.root(component)
            if p == q:
                continue
            held = self.more[0][k]
            common = len(np.intersect1d(held, shingles, assume_unique=True))
            if 100 * common >= self.percent * (len(held) + len(shingles) - common):
                self.of[max(p, q)] = min(p, q)
                self.out.append((p, q))


def _run_blocks(rows: DataFrame, kind: type, percent: int, schema: str) -> DataFrame:
    """What blocks of ``kind`` give; a row is bucket, x, y, part, and what ``hold`` and ``meet`` take."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: _Block) -> pa.RecordBatch:
            made, block.out = block.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], names=names)

        key, block = None, None
        for batch in small(batches):
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            parts, *cols = (batch.column(k).to_pylist() for k in range(3, 9))
            sets = batch.column(9) if batch.num_columns > 9 else None
            for k, own_key in enumerate(keys):
                if own_key != key:
                    if block and block.out:
                        yield out(block)
                    key, block = own_key, kind(own_key[0], percent)
                more = [] if sets is None else [sets[k].values.to_numpy()]
                (block.meet if parts[k] else block.hold)(*(c[k] for c in cols), *more)
        if block and block.out:
            yield out(block)

    return rows.mapInArrow(run, schema)


_ROW = ("bucket", "x", "y", "part", "node", "component", "few", "n", "signature")


def _near(rest: DataFrame, signed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """bucket, node of the members that have a partner by signature."""
    return _run_blocks(_dealt(rest, signed, SIGNED_LEFT, SIGNED_RIGHT, scratch).select(*_ROW), _Signed, percent, "bucket long, node long")


def _blocks(rest: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: components that a confirmed link ties."""
    return _run_blocks(_dealt(rest, sets, LEFT, RIGHT, scratch).select(*_ROW, "shingles"), _Full, percent, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nd_shingles, nd_component, nd_kept of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "minhash")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = components(narrow, scratch, size, percent)
    return out.select("doc_id", F.col("n_shingles").alias("nd_shingles"), F.col("component").alias("nd_component"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("nd_kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without documents that are linked to one of a lesser id; rows without an id stay."""
    scratch = Scratch(docs.sparkSession, "minhash-drop")
    lost = free_name("nd_gone", docs.columns)
    gone = scratch.save(near_duplicates(docs, size, percent, id_col, text_col).where(~F.col("nd_kept")).select(F.col("doc_id").alias(lost)).distinct(), "gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col(lost), "left_anti")


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text of the document that ``drop_near_duplicates`` keeps of a group.

    Rows without an id take part: each of their texts gets an id beyond those of
    the table while groups are made, so that they go where a document with an id
    is in their group.  Of them those without a word, which have no group, stay.
    """
    scratch = Scratch(docs.sparkSession, "minhash-groups")
    number, lost, repeats, first, start = (free_name(n, docs.columns) for n in ("nd_number", "nd_gone", "nd_again", "nd_part", "nd_start"))
    own = F.col(id_col).cast("long")
    no_id, has_words = own.isNull(), F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    bare = scratch.save(docs.where(no_id & has_words).dropDuplicates([text_col]).withColumn(number, F.monotonically_increasing_id()), "no-id")
    # The numbers made dense, from the largest id on: those of a part begin where the part before ends.
    part = F.shiftright(number, 33)
    base = docs.agg(F.max(own)).first()[0]
    base = -1 if base is None else base
    starts = []
    for p, n in bare.groupBy(part.alias("p")).count().orderBy("p").collect():
        starts.append((p, base + 1))
        base += n
    starts = docs.sparkSession.createDataFrame(starts, f"{first} long, {start} long")
    dense = F.col(start) + F.col(number).bitwiseAND(F.lit((1 << 33) - 1))
    bare = bare.join(F.broadcast(starts), part == F.col(first)).withColumn(number, dense).drop(first, start)

    named = docs.where(~no_id)
    every = named.select(own.alias("doc_id"), F.col(text_col).alias("text")).union(bare.select(number, text_col))
    gone = scratch.save(near_duplicates(every, size, percent).where(~F.col("nd_kept")).select(F.col("doc_id").alias(lost)).distinct(), "gone")
    left = named.join(gone, own == F.col(lost), "left_anti")
    # Only rows of repeated ids are compared by text.
    repeated = scratch.save(named.groupBy(own.alias(repeats)).count().where("count > 1").select(repeats), "repeated")
    again = left.join(repeated, own == F.col(repeats), "left_semi").dropDuplicates([id_col, text_col])
    once = left.join(repeated, own == F.col(repeats), "left_anti")
    lone = bare.join(gone, F.col(number) == F.col(lost), "left_anti").drop(number)
    return once.unionByName(again).unionByName(lone).unionByName(docs.where(no_id & ~has_words))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at two-word shingles."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
    return out.select("doc_id", F.col("nd_shingles").alias("n_shingles"), F.col("nd_component").alias("component_id"), F.col("nd_kept").alias("kept"))
