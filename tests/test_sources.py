"""File formats, providers, logging and shipping of the code."""

import logging

import pytest

from siltstone.lineage.api import LineageAnalyzer
from siltstone.lineage.logs import setup, timed
from siltstone.lineage.providers import ColumnsProvider, JsonProvider
from siltstone.sources.formats import read_table, write_table
from siltstone.sources.session import ship

SCHEMA = "id long, text string, value double"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats_give_rows_back(spark, tmp_path, kind):
    rows = [(1, 'a "quoted", text\nwith a line', 1.5), (2, None, None), (3, "", -0.25), (None, "ü", 1e300)]
    df = spark.createDataFrame(rows, SCHEMA)
    write_table(df, str(tmp_path / kind), kind)
    assert sorted(map(tuple, read_table(spark, str(tmp_path / kind), kind, SCHEMA).collect()), key=str) == sorted(rows, key=str)


def test_providers_of_columns(spark, tmp_path):
    rows = [("sales", "orders", "id", "bigint", "NO"), ("sales", "orders", "total", "double", "YES"), ("old", "orders", "x", "int", "YES")]
    p = ColumnsProvider(spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, data_type string, is_nullable string"))
    assert [(c["name"], c["nullable"]) for c in p.table("sales.orders")["columns"]] == [("id", False), ("total", True)]
    assert p.table("none") is None
    (tmp_path / "m.json").write_text('{"users": {"description": "people"}}')
    a = LineageAnalyzer()
    a.add_metadata_provider(JsonProvider(str(tmp_path / "m.json")))
    assert a.analyze("SELECT a FROM users").metadata["users"]["description"] == "people"


def test_corrections_are_told():
    a = LineageAnalyzer()
    a.analyze("SELECT TOP 5 x FROM t")
    assert a.get_dialect_correction_info() == {"original_dialect": "trino", "corrected_dialect": "tsql"}
    a.reset_dialect_correction()
    assert a.get_dialect_correction_info() is None


def test_logging(caplog):
    log = setup("DEBUG")
    n = len(log.handlers)
    assert n and setup("DEBUG") is log and len(log.handlers) == n
    log.propagate = True
    with caplog.at_level(logging.DEBUG, "siltstone"):
        timed(len)([1])
    assert "len took" in caplog.text
    log.propagate = False
    setup("WARNING")


def test_code_is_shipped_once(spark):
    ship(spark)
    before = spark.sparkContext.listFiles
    ship(spark)
    assert spark.sparkContext.listFiles == before and any("siltstone-code" in f for f in before)


def test_rows_of_topics(spark):
    from siltstone.sources import formats

    rows = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "k long, t string, x double")
    sent = formats.topic_rows(rows, "k")
    assert [r["key"] for r in sent.orderBy("key").collect()] == ["1", "2"] and formats.topic_rows(rows, None).first()["key"] is None
    received = sent.selectExpr("CAST(key AS BINARY) AS key", "CAST(value AS BINARY) AS value", "3 AS partition", "7L AS offset", "timestamp'2024-01-01' AS timestamp")
    odd = spark.createDataFrame([(b"q", b"not json")], "key binary, value binary").selectExpr("*", "0 AS partition", "0L AS offset", "timestamp'2024-01-01' AS timestamp")
    got = formats.parsed_values(received.union(odd), "k long, t string, x double").select("k", "t", "x", "record_key", "record_offset").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a", None, "1", 7), (2, None, 2.5, "2", 7), (None, None, None, "q", 0)], key=str)
    with pytest.raises(RuntimeError, match="kafka"):
        formats.read_topic(spark, "nowhere:9092", "t", "k long")


def test_queries_leave_no_views(spark, sf):
    from siltstone.plans import registry

    before = {t.name for t in spark.catalog.listTables()}
    for name in ("cte_chain", "view_multi_cte", "scalar_correlated", "join_lateral"):
        assert registry.QUERIES[name](spark, sf).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before
