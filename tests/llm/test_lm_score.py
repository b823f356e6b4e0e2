import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
import pytest

from siltstone.llm import lm_score as lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return lm.Lattice(*lm.load_vocabulary(PATH))


def splits(lattice, text):
    """All segmentations as lists of (piece, log-probability)."""
    if not text:
        yield []
        return
    for n in range(1, len(text) + 1):
        p = lattice.reach.get(text[:n], 1.0)
        p = p if p <= 0 else lattice._spelled(text) if n == 1 and len(text) == 1 else lattice._spelled(text[0]) if n == 1 else None
        if p is not None:
            for rest in splits(lattice, text[n:]):
                yield [(text[:n], p), *rest]


@pytest.mark.parametrize("word", ["the", "therean", "ñañ€𝄞", "a", "x,y|z", "aaaaaa"])
def test_all_segmentations_are_summed(lattice, word):
    every = list(splits(lattice, "▁" + word))
    total = math.log(math.fsum(math.exp(sum(p for _, p in s)) for s in every))
    assert abs(lattice.log_marginal(word.encode()) - total) < 1e-9
    want, got = Counter(), defaultdict(float)
    for s in every:
        for piece, _ in s:
            want[piece] += 2 * math.exp(sum(p for _, p in s) - total)
    lattice.expect(word.encode(), 2, got)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert abs(sum(n * len(p) for p, n in got.items()) - 2 * len("▁" + word)) < 1e-9


def test_weights_are_a_distribution():
    names, logp = lm.load_vocabulary(PATH)
    assert abs(np.exp(logp).sum() - 1) < 1e-9 and len(set(names)) == len(names) and all(bytes([b]) in names for b in range(256))


def brute(rows, held):
    words = {i: lm.tokens((t or "").encode()) for i, (_, t) in enumerate(rows)}
    c = Counter(w for i, (d, _) in enumerate(rows) if not held(d) for w in words[i])
    n, v = sum(c.values()), len(c)
    return sorted((-1 if d is None else d, len(words[i]), sum(c[w] > 0 for w in words[i]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]), 6)) for i, (d, _) in enumerate(rows))


def test_all_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = lm.op8_lm_score(spark, sf).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    assert sorted((r[0], r[2], r[3], r[4], round(r[5], 6)) for r in got) == brute(rows, held)
    assert all(r["held_out"] == held(r["doc_id"]) and r["score"] < 0 for r in got)


def test_rare_words_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "The the THE cat"), (3, "The the THE cat"), (None, "dog ünï " + "z" * 3000), (4, "w " * 50_000 + "rare"), (5, "other\x0bwords here"), (7, "z" * 3000)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n long, word string").repartition(2)
    outs = []
    for hot in (1 << 17, 2, 0):
        out = lm.score_documents(docs, PATH, F.col("doc_id") != 5, hot_bytes=hot * lm.HOT_WORD).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:4], round(r[4], 6)) for r in out) == brute(rows, lambda d: d == 5)
        outs.append(sorted((-1 if r[0] is None else r[0], round(r[5], 6)) for r in out))
    assert outs[0] == outs[1] == outs[2]
    empty = [s for d, s in outs[0] if d in (1, 2)]
    assert empty[0] == empty[1] < 0


def test_no_rows_and_no_training(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.score_documents(docs.limit(0), PATH, F.lit(True)).count() == 0
    got = lm.score_documents(docs, PATH, F.lit(False)).first()
    lattice = lm.Lattice(*lm.load_vocabulary(PATH))
    assert got["n_known"] == got["train_tokens"] == 0 and got["base_score"] == 0
    assert abs(got["score"] * math.log(10) - sum(map(lattice.log_marginal, (b"a", b"b", b"")))) < 1e-6


def brute_scores(rows, held, adapt, word_edges):
    """Scores by listing every segmentation of every word."""
    every = [lm.tokens((t or "").encode()) for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, every) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    names, logp = lm.load_vocabulary(PATH)
    lattice = lm.Lattice(names, logp)
    if adapt:
        count = dict(zip(names, np.exp(logp) * 10_000))
        for w, times in c.items():
            if w == lm.END:
                count[w] += times
                continue
            ways = [(s, math.exp(sum(p for _, p in s))) for s in splits(lattice, "▁" + w.decode())]
            for s, p in ways:
                for piece, _ in s:
                    raw = piece.encode()
                    for name in [raw] if raw in count else [bytes([b]) for b in raw]:
                        count[name] += times * p / sum(q for _, q in ways)
        weight = np.array([count[x] for x in names])
        lattice = lm.Lattice(names, np.log(weight / weight.sum()))

    def probability(w):
        p = math.exp(lattice.end) if w == lm.END else math.fsum(math.exp(sum(q for _, q in s)) for s in splits(lattice, "▁" + w.decode()))
        return (c[w] + v * p) / (n + v) if word_edges and n else p

    return sorted((d, round(sum(math.log10(probability(w)) for w in ws), 6)) for (d, _), ws in zip(rows, every))


@pytest.mark.parametrize("adapt, word_edges", [(True, True), (True, False), (False, True)])
def test_scores_by_all_segmentations(spark, adapt, word_edges):
    rows = [(1, "The cat sat"), (2, "a cat, a hat; the end"), (3, None), (4, "ünï €5 zq"), (5, "cat zzz new"), (6, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.score_documents(docs, PATH, F.col("doc_id") != 5, adapt=adapt, word_edges=word_edges).collect()
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in got) == brute_scores(rows, lambda d: d == 5, adapt, word_edges)


def test_word_edges_fit_better(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 4 == 0
    total = lambda **k: lm.score_documents(docs, PATH, ~held, **k).join(docs.where(held), "doc_id", "left_semi").agg(F.sum("score")).first()[0]
    assert total() > total(word_edges=False)


def test_copies_stand_out(spark):
    """A text of rare words that occurs twice scores above its like that occurs once, and that above one never seen."""
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("aeioklmnrst") for _ in range(7)) for _ in range(60))
    rows = [(k, text()) for k in range(40)]
    rows += [(100 + k, t) for k, t in rows[:10]] + [(200 + k, text()) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    score = {x["doc_id"]: x["score"] for x in lm.score_documents(docs, PATH, F.col("doc_id") < 200).collect()}
    assert min(score[k] for k in range(10)) > max(score[k] for k in range(10, 40)) and min(score[k] for k in range(10, 40)) > max(score[200 + k] for k in range(10))


def test_long_words_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNT_BYTES", 10_000)
    rows = [(k, f"{'x' * 3000}{k} common " * 3) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = lm.score_documents(docs, PATH, F.lit(True)).collect()
    assert sorted((r[0], *r[1:4], round(r[4], 6)) for r in out) == brute(rows, lambda d: False)


def test_adapted_weights_fit_better(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 4 == 0
    total = lambda **k: lm.score_documents(docs, PATH, ~held, **k).join(docs.where(held), "doc_id", "left_semi").agg(F.sum("score")).first()[0]
    assert total() > total(adapt=False)
