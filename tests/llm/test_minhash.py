import random

import numpy as np
import pytest

from siltstone.llm import minhash
from siltstone.llm.common import Scratch, hashed_texts
from siltstone.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, size):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    of = {d: d for d, _ in rows}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= percent * (len(a) + len(sets[j]) - k):
                p, q = root(rows[i][0]), root(rows[j][0])
                of[max(p, q)] = min(p, q)
    return sorted((d, len(s), root(d), root(d) == d) for (d, _), s in zip(rows, sets))


@pytest.mark.parametrize("size", [2, 5])
def test_all_documents(spark, sf, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, minhash.near_duplicates(docs, size).collect()))
    assert got == brute([tuple(r) for r in docs.collect()], size)


def test_groups_in_blocks(spark, monkeypatch):
    """Many near copies whose links do not all go to one leader, over several blocks."""
    for name, n in (("LEFT", 4), ("RIGHT", 8), ("SIGNED_LEFT", 5), ("SIGNED_RIGHT", 7)):
        monkeypatch.setattr(minhash, name, n)
    r = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for d in range(90):
        words = list(base)
        for k in r.sample(range(60), r.choice([2, 4, 6, 8])):
            words[k] = f"x{r.randint(0, 40)}"
        rows.append((d, " ".join(words)))
    rows += [(d + 100, rows[d][1].upper()) for d in range(0, 90, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, minhash.near_duplicates(docs, 2).collect())) == brute(rows, 2)


def boilerplate(n, seed=1):
    """Texts that share half of their words, and a few links."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(80)]
    rows = [(d, " ".join([*base, *(f"d{d}w{k}" for k in range(40))])) for d in range(n)]
    for d in range(0, n, 50):
        words = rows[d][1].split()
        words[r.randrange(80, 120)] = "other"
        rows[d + 7] = (d + 7, " ".join(words))
    return rows


def test_boilerplate_ships_no_sets_but_those_of_links(spark, monkeypatch):
    shipped, blocks = [], minhash._blocks

    def counting(rest, sets, percent, scratch):
        shipped.append(minhash._dealt(rest, sets, minhash.LEFT, minhash.RIGHT, scratch).count())
        return blocks(rest, sets, percent, scratch)

    monkeypatch.setattr(minhash, "_blocks", counting)
    docs = spark.createDataFrame(boilerplate(600), "doc_id long, text string").repartition(4)
    got = {r[0]: r[1] for r in minhash.near_duplicates(docs, 2).select("doc_id", "nd_component").collect()}
    assert got == {d: d - 7 if d % 50 == 7 else d for d in range(600)}
    assert sum(shipped) < 1200


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e"), (8, "a b c d e f"), (9, "x " * 60_000), (10, "x " * 60_000 + "y"), (11, "a\x0bb\x85c d")]
    docs = spark.createDataFrame([(*r, "z", True) for r in [*rows, (None, "one")]], "doc_id long, text string, component string, nd_kept boolean")
    got = [tuple(r) for r in minhash.near_duplicates(docs, 2).collect()]
    assert sorted(r for r in got if r[0] is not None) == brute(rows, 2)
    assert [r for r in got if r[0] is None] == [(None, 1, None, True)]
    assert minhash.near_duplicates(docs.limit(0), 2).count() == 0
    left = minhash.drop_near_duplicates(docs, 2)
    assert left.columns == docs.columns and left.count() == len(rows) + 1 - sum(not r[3] for r in brute(rows, 2))


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "p q r s t u"), (3, "a b c d e f"), (9, "p q r s t u"), (9, "p q r s t u")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, 2).select("doc_id", "nd_component").collect()))
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (9, 3)]


def test_word_hashes_do_not_depend_on_what_is_around():
    texts = [b"alpha beta", b"", b"  beta\talpha  ", "ünï beta".encode(), b"y" * 5_000_000 + b" beta"]
    out = {}
    for a, b, words, at in hashed_texts(texts):
        for k in range(a, b):
            out[k] = words[at[k - a] : at[k - a + 1]].tolist()
    assert [len(out[k]) for k in range(5)] == [2, 0, 2, 2, 2]
    assert out[0][1] == out[2][0] == out[3][1] == out[4][1] and out[0][0] == out[2][1]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:800], r.integers(0, 2**63, 200, dtype=np.uint64)]))
    agree = (minhash.minima(a) == minhash.minima(b)).mean()
    assert abs(agree - 800 / 1200) < 0.15


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = dict(map(tuple, connected_components(df, Scratch(spark, "cc-test")).collect()))
    of = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert got == {x: c for x, c in of.items() if sum(c == y for y in of.values()) > 1}
    assert connected_components(df.limit(0), Scratch(spark, "cc-test")).count() == 0
