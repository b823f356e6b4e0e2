import math
import zlib

import numpy as np

from siltstone.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_every_document_once_and_alike(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r[0]: r[2] for r in quality.op3_quality(spark, sf).collect()}
    assert len(got) == docs.count()
    by_text = {}
    for d, t in docs.select("doc_id", "text").collect():
        assert by_text.setdefault(t, got[d]) == got[d]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "BAD!! BAD!!"), (4, "w " * 200_000), (5, " \n\t ")]
    docs = spark.createDataFrame([(*r, "x", 2.0) for r in rows], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (9, 1), (1, None), (None, 1)], "doc_id long, quality int")
    w = quality.train(docs, labels)
    got = [tuple(r) for r in quality.score(docs, w).select("doc_id", "text", "score").collect()]
    empty = {s for _, t, s in got if not (t or "").strip()}
    assert len(got) == 7 and len(empty) == 1 and all(0 < s < 1 for *_, s in got)
    none = quality.train(docs, labels.limit(0))
    assert {r[0] for r in quality.score(docs, none).select("score").collect()} == {0.5}
    assert quality.score(docs.limit(0), w).count() == 0
    assert quality.score(docs, w).columns == ["doc_id", "text", "label", "score"]


def test_an_id_that_many_rows_repeat_is_learned_from_a_few_times(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "other words")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    few = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "other words")], "doc_id long, text string").repartition(2)
    w = quality.train(docs, labels)
    assert np.array_equal(w, quality.train(few, labels)) and not np.array_equal(w, quality.train(docs, labels, max_texts=1))


def brute_scores(docs, labels):
    """Weights and scores by dictionaries, a slot at a time."""
    def grams(text):
        out = {}
        (_, _, slots, _), = quality.features([(text or "").encode()])
        for s in slots.tolist():
            out[s] = out.get(s, 0) + 1
        return out

    def row(text):
        g = grams(text)
        return {**{s: n * quality.SCALE / max(1, sum(g.values())) for s, n in g.items()}, "bias": 1.0}

    z, n = {}, {}

    def weight(s):
        if abs(z.get(s, 0.0)) <= 1e-4:
            return 0.0
        return -(z[s] - math.copysign(1e-4, z[s])) / (1 + math.sqrt(n[s]) + 1e-3)

    for _ in range(3):
        for text, y in docs:
            x = row(text)
            w = {s: weight(s) for s in x}
            g = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x.items()))) - y
            for s, v in x.items():
                step = math.sqrt(n.get(s, 0) + (g * v) ** 2) - math.sqrt(n.get(s, 0))
                z[s] = z.get(s, 0) + g * v - step * w[s]
                n[s] = n.get(s, 0) + (g * v) ** 2
    return lambda text: 1 / (1 + math.exp(-sum(weight(s) * v for s, v in row(text).items())))


def test_trained_scores_against_dictionaries(spark, sf):
    import pyspark.sql.functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out())
    order = [F.xxhash64("doc_id"), "doc_id"]
    rows = [(r["text"], r["quality"]) for r in docs.join(labels.where("quality in (0, 1)"), "doc_id").orderBy(*order).collect()]
    want = brute_scores(rows, None)
    got = quality.op3_quality(spark, sf).join(docs, "doc_id").select("text", "score").collect()
    assert max(abs(want(t) - s) for t, s in got) < 1e-9


def test_scores_are_dot_products():
    r = np.random.default_rng(1)
    w = r.normal(size=(1 << 10) + 1)
    texts = [b"a b c a b", b"", b"Hello!! WORLD 12", "ñandú ñandú".encode()]
    got = quality.scores(texts, w, bits=10)
    for t, s in zip(texts, got):
        (_, _, slots, at), = quality.features([t], bits=10)
        z = w[-1] + quality.SCALE * sum(w[slots]) / max(1, len(slots))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12 and at[-1] == len(slots)


def test_one_update_follows_the_formula():
    m = quality.Ftrl(3, alpha=0.5, beta=1.0, l1=0.01, l2=0.1)
    m.learn(np.array([0, 3]), np.array([2.0, 1.0]), 1)
    g = (0.5 - 1) * 2.0
    assert np.isclose(m.z[0], g) and np.isclose(m.n[0], g * g)
    assert np.isclose(m.weights()[0], -(g + 0.01) / ((1 + abs(g)) / 0.5 + 0.1))
