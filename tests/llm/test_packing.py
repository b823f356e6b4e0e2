import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


SLOW = Tokenizer.from_file(PATH)


def tokens(text):
    return [*SLOW.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, docs, window):
    """Each id in exactly one piece, windows gapless from 0 and never too long."""
    left = sorted(map(tuple, (r[:5] for r in pieces)), key=str)
    assert len(left) == len(pieces)
    by_doc = {}
    for doc, start, length, ids, total, seq, offset in pieces:
        assert len(ids) == 4 * length and length > 0
        by_doc.setdefault(doc, []).append((start, np.frombuffer(ids, "<u4").tolist(), total))
    want = {}
    for doc, text in docs:
        want.setdefault(doc, []).append(tokens(text))
    assert set(by_doc) == set(want)
    for doc, texts in want.items():
        assert sum(len(x[1]) for x in by_doc[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            own = sorted(by_doc[doc])
            assert [x[0] for x in own] == np.cumsum([0, *(len(x[1]) for x in own[:-1])]).tolist()
            assert [i for x in own for i in x[1]] == texts[0] and {x[2] for x in own} == {len(texts[0])}
    windows = {}
    for p in pieces:
        windows.setdefault(p[5], []).append((p[6], p[2]))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == np.cumsum([0, *(n for _, n in w[:-1])]).tolist()
        assert sum(n for _, n in w) <= window
    return [sum(n for _, n in w) for w in windows.values()]


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pieces = [tuple(r) for r in packing.pack(docs, PATH).collect()]
    fill = check(pieces, [tuple(r) for r in docs.collect()], 1024)
    assert all(n & (n - 1) == 0 for n in fill)  # no padding at all
    assert sum(n == 1024 for n in fill) >= sum(fill) // 1024 - len({p[5] >> 36 for p in pieces})
    got = {(r[0], r[1]): r[3] for r in packing.op1_packing(spark, sf).collect()}
    assert got == {(p[0], p[1]): zlib.crc32(p[3]) for p in pieces}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "word " * 3000), (5, "<|endoftext|> x"), (6, "ünï \x00   😀")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, sequence_id string, length long").repartition(1)
    pieces = [tuple(r) for r in packing.pack(docs, PATH, window=64).collect()]
    fill = check(pieces, rows, 64)
    assert all(n & (n - 1) == 0 for n in fill) and sum(n < 64 for n in fill) <= 6
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_no_more_windows_are_open_than_told(spark, monkeypatch):
    """Documents of 600 tokens fit with none of their like; memory stays bounded, and nothing is padded."""
    rows = [(k, f"{k % 10} " + "the " * 597) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    fill = check([tuple(r) for r in packing.pack(docs, PATH, most_open=16).collect()], rows, 1024)
    assert all(n & (n - 1) == 0 for n in fill) and sum(n < 1024 for n in fill) <= 10
    bins, most = packing.SumOfSquares(1024), 0
    for k in range(500):
        bins.place([k, 0, np.zeros(600, "<u4"), 600], 600)
        most = max(most, int(bins.count.sum()))
        if bins.count.sum() > 16:
            assert all(sum(len(p[2]) for p in w) == 1024 for w in bins.level()) and bins.count.sum() <= 1
    assert most <= 17


def test_both_encoders_agree(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["don't  stop\n\n x", "１２３ ¼ Ⅷ", " 　 a\tb", "'s 'S 'll", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\n<|endoftext", "=" * 50_000, "x" * 200_000 + "<|endoftext|>"]
    t = Tokenizer.from_file(PATH)
    assert packing.make_encoder(PATH)(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["x" + " " * 2_000_000 + "y", "\n " * 1_000_000, "a, " + "\u3000\xa0\n" * 700_000 + "!b" + " " * 150_000 + "'s \x1c" + "\r\n" * 60_000 + "１"], ids=["blanks", "to the end", "several"])
def test_long_runs_of_white_space(text):
    t = Tokenizer.from_file(PATH)
    assert packing.make_encoder(PATH)([text]) == [t.encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("seed", range(3))
def test_level_minimises_the_sum_of_squares(seed):
    r = np.random.default_rng(seed)
    bins = packing.SumOfSquares(20)
    for n in r.integers(1, 20, 300).tolist():
        count = bins.count.copy()

        def after(h):
            c = count.copy()
            if h:
                c[h] -= 1
            if h + n < 20:
                c[h + n] += 1
            return int((c**2).sum())

        allowed = [0, *(h for h in range(1, 20 - n + 1) if count[h])]
        assert after(bins.level_for(n)) == min(map(after, allowed))
        bins.place([0, 0, np.zeros(n, "<u4"), n], n)
        assert [len(x) for x in bins.open] == bins.count.tolist()
