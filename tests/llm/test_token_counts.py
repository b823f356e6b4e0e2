from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import token_counts as tc
from siltstone.llm.common import Scratch

CHANGES = "source string, lang string, tokenizer string, tokens long"


def totals(store):
    return sorted((tuple(r) for r in store.totals().collect()), key=str)


def test_all_documents(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for source, lang, text in spark.read.parquet(f"{sf}/documents.parquet").select("source", "lang", "text").collect():
        n = len(text.encode().split())
        for name, k in (("words", n), ("byte_bpe_50k", len(t.encode(text, add_special_tokens=False).ids))):
            if n:
                own = want.setdefault((source, lang, name), Counter())
                own.update(documents=1, tokens=k)
    got = {tuple(r[:3]): (r[3], r[4]) for r in tc.op7_token_counts(spark, sf).collect()}
    assert got == {k: (v["documents"], v["tokens"]) for k, v in want.items()}


@pytest.fixture
def store(spark):
    return tc.Rollup(spark, Scratch(spark, "rollup-test").path("store"))


def test_batches_count_once(spark, store):
    a = spark.createDataFrame([("s", "en", "v", 5), ("s", "en", "v", 5), (None, "de", "v", 7), ("s", None, "w", 0)], CHANGES)
    assert totals(store) == []
    assert store.commit("one", tc.inserted(a)) and not store.commit("one", tc.inserted(a))
    first = totals(store)
    assert first == sorted([("s", "en", "v", 2, 10), (None, "de", "v", 1, 7), ("s", None, "w", 1, 0)], key=str)
    store.compact()
    assert totals(store) == first and not store.commit("one", tc.inserted(a))
    new = spark.createDataFrame([("s", "fr", "v", 9)], CHANGES)
    store.commit("two", tc.revised(a.where("source is null"), new))
    store.commit("three", tc.deleted(a.where("lang is null")))
    store.commit("four", tc.inserted(a.limit(0)))
    assert totals(store) == sorted([("s", "en", "v", 2, 10), ("s", "fr", "v", 1, 9)], key=str)
    store.compact()
    store.compact()
    assert totals(store) == sorted([("s", "en", "v", 2, 10), ("s", "fr", "v", 1, 9)], key=str)


def test_a_writer_that_dies_leaves_nothing(spark, store, monkeypatch):
    a = spark.createDataFrame([("s", "en", "v", 5)], CHANGES)

    def dies(*_):
        raise RuntimeError

    with monkeypatch.context() as m:
        m.setattr(store, "_mark", dies)
        with pytest.raises(RuntimeError):
            store.commit("one", tc.inserted(a))
    assert totals(store) == []
    assert store.commit("one", tc.inserted(a)) and totals(store) == [("s", "en", "v", 1, 5)]


def test_odd_texts(spark):
    rows = [("s", "en", None), ("s", "en", ""), ("s", "en", "a b c \x0b d")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "source string, lang string, text string, tokens long, tokenizer string")
    assert [r["tokens"] for r in tc.count_tokens(docs, None, "words").collect()] == [0, 0, 3]
    assert [r["tokens"] > 0 for r in tc.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), "b").collect()] == [False, False, True]
    with pytest.raises(ValueError):
        tc._name("a/b")


def test_a_commit_during_compaction_counts_once(spark, store, monkeypatch):
    a = spark.createDataFrame([("s", "en", "v", 5)], CHANGES)
    store.commit("one", tc.inserted(a))
    summed = tc._summed

    def commits_meanwhile(changes):
        with monkeypatch.context() as m:
            m.setattr(tc, "_summed", summed)
            store.commit("two", tc.inserted(a))
        return summed(changes)

    with monkeypatch.context() as m:
        m.setattr(tc, "_summed", commits_meanwhile)
        store.compact()
    assert totals(store) == [("s", "en", "v", 2, 10)]
    store.compact()
    assert totals(store) == [("s", "en", "v", 2, 10)]


@pytest.mark.parametrize("way", ["link", "rename"])
def test_of_two_writers_one_wins(spark, store, monkeypatch, way):
    if way == "rename":
        monkeypatch.setattr(store, "_place", store._renamed)
    a, b = (spark.createDataFrame([("s", "en", "v", n)], CHANGES) for n in (5, 7))
    other = tc.Rollup(spark, store.folder)
    mark = store._mark

    def late(*x):
        assert other.commit("one", tc.inserted(b))
        return mark(*x)

    with monkeypatch.context() as m:
        m.setattr(store, "_mark", late)
        assert not store.commit("one", tc.inserted(a))
    assert totals(store) == [("s", "en", "v", 1, 7)]
    assert not store.commit("one", tc.inserted(a)) and not store.commit("one", tc.inserted(b), compare=True)
    with pytest.raises(tc.BatchConflict):
        store.commit("one", tc.inserted(a), compare=True)


def test_two_compactions_at_once(spark, store, monkeypatch):
    a = spark.createDataFrame([("s", "en", "v", 5)], CHANGES)
    store.commit("one", tc.inserted(a))
    other, mark = tc.Rollup(spark, store.folder), store._mark

    def late(*x):
        store._mark = mark
        other.commit("two", tc.inserted(a))
        other.compact()
        return mark(*x)

    store._mark = late
    store.compact()
    assert totals(store) == [("s", "en", "v", 2, 10)]


def test_vacuum_frees_files_and_keeps_totals(spark, store):
    a = spark.createDataFrame([("s", "en", "v", 5)], CHANGES)
    files = lambda: len(list(store._fs.listStatus(store._path("data"))))
    store.vacuum()
    for k in range(5):
        store.commit(f"b{k}", tc.inserted(a))
        store.compact()
    before = files()
    store.commit("last", tc.inserted(a))
    store.vacuum(keep=1)
    assert files() == 2 < before and totals(store) == [("s", "en", "v", 6, 30)]
    assert not store.commit("b0", tc.inserted(a))
    with pytest.raises(tc.BatchConflict):
        store.commit("b0", tc.inserted(a), compare=True)
    store.compact()
    store.vacuum()
    assert totals(store) == [("s", "en", "v", 6, 30)]
