from siltstone.llm import license_scan as ls

from ..compare import same

MIT = next(t for n, t in ls.KNOWN if n == "MIT")


def found(spark, texts, **k):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ls_license string, name string")
    out = ls.scan_licenses(docs, **k)
    assert set(out.columns) == {"doc_id", "text", "name", "ls_digest", "ls_license"}
    return [r["ls_license"] for r in out.orderBy("doc_id").collect()]


def test_all_documents(spark, sf, duck):
    same(ls.op6_license_scan(spark, sf), duck, ls.OP6_SQL)


def test_known_texts_in_other_clothes(spark, sf, duck):
    same(ls.license_known_texts(spark, sf), duck, ls.known_texts_sql())
    rows = {r["doc_id"]: r["license"] for r in ls.license_known_texts(spark, sf).where("doc_id < 0").collect()}
    names = [n for n, _ in [*ls.KNOWN, *ls.whole_texts()]]
    for k, name in enumerate(names):
        assert [rows[-(k * 5 + n + 1)] for n in range(5)] == [name] * 4 + [None]


def test_words_in_a_row_and_carriage_returns(spark):
    docs = spark.createDataFrame([(0, "Per cent per-cent, THE COPYRIGHT OWNERS sub-licence non-infringement"), (1, "Copyright 2020 X\rall rights reserved\rtext\u2028copyright 2020 y"), (2, "copyright owner copyright owner per cent")], "doc_id long, text string")
    got = [r[0] for r in docs.orderBy("doc_id").select(ls.canonical(docs.text)).collect()]
    assert got == ["percent percent the copyright holders sublicense noninfringement", "text\u2028copyright 2020 y", "copyright holder copyright holder percent"]


def test_spellings_of_one_text(spark):
    texts = [MIT, MIT.upper(), "Copyright (c) 2020 Some Body\n\n" + MIT, "  (C) 1999, 2001 X. All rights reserved.\n© 2010 Y\n" + MIT.replace("sublicense", "sublicence").replace('"', "“"), MIT.replace(" ", "\n\n  "), MIT + " more", MIT[:-20], None, "", "Copyright 2020", "…!?", "released under the mit license"]
    assert found(spark, texts) == ["MIT"] * 5 + [None] * 6 + ["MIT"]


def test_each_known_text_is_found(spark):
    assert found(spark, [t for _, t in ls.KNOWN]) == [n for n, _ in ls.KNOWN]


def test_whole_texts_are_found(spark):
    whole = dict(ls.whole_texts())
    assert {"Apache-2.0", "CC0-1.0", "Unlicense", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0"} <= set(whole)
    assert found(spark, [t.replace("\n", "\n  ").upper() for t in whole.values()]) == list(whole)
    assert found(spark, [t[: len(t) // 2] for t in whole.values()]) == [None] * len(whole)


def test_long_lists_are_joined_by_shuffle(spark):
    assert found(spark, [MIT, "x", MIT], most_broadcast=2) == ["MIT", None, "MIT"]


def test_neighbouring_words_are_both_replaced(spark):
    docs = spark.createDataFrame([(0, "Licence licence, LICENCE whilst favour")], "doc_id long, text string")
    assert docs.select(ls.canonical(docs.text)).first()[0] == "license license license while favor"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ls.scan_licenses(docs).count() == 0
    one = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert ls.scan_licenses(one, spark.createDataFrame([], "name string, text string")).first()["ls_license"] is None
