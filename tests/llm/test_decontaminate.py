import hashlib
import random
import re

import numpy as np
import pytest

from siltstone.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=10):
    seqs = [(str(i), words(t)) for i, t in items if i is not None]
    out = []
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for name, s in seqs:
            n = min(window, len(s))
            grams = {tuple(s[k : k + n]) for k in range(len(s) - n + 1)} if s else set()
            for k in range(len(w) - n + 1) if s else ():
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add(name)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(spark, docs, items, **k):
    import pyspark.sql.functions as F

    d = spark.createDataFrame([(*r, "x", [1]) for r in docs], "doc_id long, text string, dc_items string, words array<int>")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = dc.scan(d, b, **k)
    n = F.aggregate("dc_spans", F.lit(0), lambda a, s: a + s[1] - s[0])
    rows = out.select("doc_id", "dc_n_words", n, F.size("dc_items"), F.sha2(F.array_join("dc_items", ",").cast("binary"), 256), n > 0).collect()
    return sorted(map(tuple, rows), key=str)


def test_all_documents(spark, sf):
    read = lambda t, i: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert sorted(map(tuple, dc.op10_decontamination(spark, sf).collect()), key=str) == want


@pytest.mark.parametrize("seed, max_words", [(0, 10**6), (1, 10**6), (2, 12)])
def test_random_texts(spark, seed, max_words):
    r = random.Random(seed)
    text = lambda n, v: " ".join(r.choice("abcdefgh"[:v]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 2, 3, 4, 6, 9]), 4)) for k in range(14)]
    docs = [(k, text(r.randint(0, 40), 6)) for k in range(40)]
    assert got(spark, docs, items, window=4, max_words=max_words) == brute(docs, items, 4)


def test_odd_rows(spark):
    items = [(1, "One two-three; four five six seven eight nine TEN"), (1, "one two-three; four five six seven eight nine ten"), (2, None), (3, ""), (4, "Ünï cödé"), (None, "x"), (5, "!!")]
    docs = [(1, None), (2, ""), (3, "zero one TWO three four five six seven eight nine ten eleven"), (3, "ünï cödé"), (None, "Ünï, cödé"), (4, "q " * 50_000 + "Ünï cödé"), (5, "ünï x cödé")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, []) == brute(docs, []) and got(spark, [], items) == []


def test_spans_are_cut(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rest = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame(
        [(1, f"Before: {item.title()}. After {rest}", 1, "k"), (2, "clean text", 10, "k"), (3, item, 9, "k"), (4, None, None, "k"), (5, f"{rest} é, one two three four five six seven eight nine ten ü", 5, "k")],
        "doc_id long, text string, n_chars int, kept string",
    )
    bench = spark.createDataFrame([(1, item), (2, "clean text")], "item_id long, text string")
    out = dc.remove_spans(docs, bench, max_coverage=0.5)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    cut = f"Before: . After {rest}"
    assert rows == {1: (cut, len(cut)), 4: (None, None), 5: (f"{rest} é,  ü", len(rest) + 6)}
    assert not words(cut)[1:2] == ["one"] and dc.remove_spans(out, bench).count() == 3


def test_automaton_matches_the_longest(monkeypatch):
    items = [b"abcbc", b"bcbcd"]
    arrays = dc.Block.build([(n, np.array(list(seq), np.uint64)) for n, seq in zip("ab", items)], 3)
    block, text = dc.Block(arrays, 3), list(b"xabcbcdq")
    known = arrays["known"].tolist()
    _, lengths = block._walk(np.array([known.index(c) if c in known else -1 for c in text]))

    def longest(k):
        return max(n for n in range(k + 2) if n == 0 or any(bytes(text[k + 1 - n : k + 1]) in e for e in items))

    assert lengths.tolist() == [longest(k) for k in range(len(text))]
    assert len(arrays["link"]) <= 2 * 10


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_long_runs_are_walked_in_chunks(spark, monkeypatch, chunk):
    """Texts of known words alone, whose matches go over the ends of chunks."""
    r = random.Random(chunk)
    item = [r.choice("abc") for _ in range(60)]
    items = [(1, " ".join(item)), (2, "a b"), (3, " ".join(item[20:29]) + " c")]
    texts = [(k, " ".join(r.choice("abc") for _ in range(200)) + " " + " ".join(item[k : k + 25])) for k in range(20)]
    monkeypatch.setattr(dc, "CHUNK", chunk)
    blocks = [dc.Block(dc.Block.build([(str(i), hashes) for i, hashes in zip("123", [hashed(t) for _, t in items])], 6), 6)]
    for k, text in texts:
        own, found = hashed(text), [set()]
        hit = np.zeros(len(own), bool)
        blocks[0].scan(own, np.array([0, len(own)]), hit, found)
        want = brute([(k, text)], items, 6)[0]
        assert (len(own), int(hit.sum()), len(found[0])) == want[1:4]


def hashed(text):
    return next(dc.hashed_texts([text.encode()], dc.WORDS))[2]


def test_a_long_item_is_cut_into_blocks(spark):
    r = random.Random(9)
    long = [f"w{r.randint(0, 300)}" for _ in range(5000)]
    items = [(1, " ".join(long)), (2, "w1 w2"), (3, " ".join(long[100:180]))]
    docs = [(k, f"x {' '.join(long[k * 97 : k * 97 + 40])} y {' '.join(long[-15:])} w1 w2") for k in range(40)]
    assert got(spark, docs, items, max_words=64) == brute(docs, items)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d", [5], "i")], "doc_id long, text string, dc_spans array<int>, DC_ITEMS string")
    out = dc.remove_spans(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"), least_words=1)
    assert out.schema == docs.schema and [tuple(r) for r in out.collect()] == [(1, "a  d", [5], "i")]


@pytest.mark.parametrize("max_words", [10**6, 5])
def test_items_without_an_id_hit_too(spark, max_words):
    docs = [(1, "x a b c d e y"), (2, "x p q y"), (3, "f g h i"), (4, "none")]
    items = [(None, "a b c d e"), (None, "p q"), (7, "f g h i"), (None, "g h i j")]
    digest = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    want = [(1, 7, 5, 0, digest(""), True), (2, 4, 2, 0, digest(""), True), (3, 4, 4, 1, digest("7"), True), (4, 1, 0, 0, digest(""), False)]
    assert got(spark, docs, items, window=3, max_words=max_words, nameless=True) == want
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    left = dc.remove_spans(texts, spark.createDataFrame(items, "item_id long, text string"), window=3, least_words=1, max_coverage=0.8, max_words=max_words, nameless=True)
    assert {r[0]: r[1].split() for r in left.collect()} == {1: ["x", "y"], 2: ["x", "y"], 4: ["none"]}


def test_op10_and_the_pipeline_take_items_without_an_id(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"b{k}" for k in range(12))
    own = " ".join(f"w{k}" for k in range(20))
    spark.createDataFrame([(None, passage)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"{own} {passage}"), (2, own)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in dc.op10_decontamination(spark, str(tmp_path)).collect()}
    assert found == {1: (12, 0, True), 2: (0, 0, False)}
    left = corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()
    assert {r[0]: r[1].split() for r in left} == {1: own.split(), 2: own.split()}
