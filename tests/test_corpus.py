"""Relations over many statements, graphs, sinks and streams."""

import random

import pyspark.sql.functions as F
import pytest

from siltstone.lineage import graph
from siltstone.lineage.api import LineageAnalyzer
from siltstone.lineage.corpus import PARSED, Corpus, parse_statements, read_statements
from siltstone.lineage.providers import CatalogProvider
from siltstone.sources.sinks import RELATIONS, create_table_as, write_corpus
from siltstone.streaming.statements import stream_table_edges, windowed_counts


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_corpus_equals_the_analyzer(spark):
    sqls = ["SELECT a FROM t", "CREATE TABLE x AS SELECT b FROM y JOIN z ON y.i = z.i", None, "broken (", "WITH c AS (SELECT 1 AS n FROM d) SELECT n FROM c WHERE n > 0"]
    c = Corpus(parse_statements(spark.createDataFrame(list(enumerate(sqls)), "stmt_id long, sql string").repartition(3)))
    a = LineageAnalyzer()
    want = sorted((k, t, s) for k, q in enumerate(sqls) for t, ss in a.analyze(q).table_lineage.upstream.items() for s in ss)
    assert rows(c.table_edges()) == want
    assert rows(c.statements().where(F.size("errors") > 0).select("stmt_id")) == [(2,), (3,)]
    assert c.parsed.columns == PARSED.names


def test_empty_corpus(spark):
    c = Corpus(parse_statements(spark.createDataFrame([], "stmt_id long, sql string")))
    assert [c.table_edges().count(), c.joins().count(), c.filters().count(), c.summary().count()] == [0] * 4


def test_files_of_statements(spark, tmp_path):
    (tmp_path / "a.sql").write_text("-- first\nSELECT a\nFROM t")
    (tmp_path / "b.sql").write_text("SELECT b FROM u")
    c = Corpus(parse_statements(read_statements(spark, str(tmp_path))))
    assert rows(c.table_edges().select("source")) == [("t",), ("u",)]


def brute(edges):
    out = {}
    for key, p, _ in edges:
        seen, front, d = {}, [p], 0
        while front:
            d += 1
            front = [c for k, a, c in edges if k == key and a in front and c not in seen]
            front = list(dict.fromkeys(front))
            seen |= {c: d for c in front}
        out |= {(key, p, n): d for n, d in seen.items()}
    return sorted((*k, d) for k, d in out.items())


@pytest.mark.parametrize("seed", range(2))
def test_graphs_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 1), f"n{r.randint(0, 9)}", f"n{r.randint(0, 9)}") for _ in range(16)]
    df = spark.createDataFrame(edges, "k long, p string, c string")
    want = brute(edges)
    assert rows(graph.closure(df, "k", "p", "c")) == want
    assert rows(graph.cycles(df, "k", "p", "c")) == sorted((k, a) for k, a, b, _ in want if a == b)
    assert rows(graph.closure(df, "k", "p", "c", max_depth=1)) == sorted({(*e, 1) for e in edges})
    assert rows(graph.fanout(df, "k", "p", "c")) == sorted((k, p, len({c for x, y, c in edges if (x, y) == (k, p)})) for k, p in {(x, y) for x, y, _ in edges})


def test_depths_and_paths(spark):
    df = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "a", "c"), (0, "c", "d"), (1, "a", "z")], "k long, p string, c string")
    assert rows(graph.depths(df, "k", "p", "c")) == [(0, "a", 0), (0, "b", 1), (0, "c", 2), (0, "d", 3), (1, "a", 0), (1, "z", 1)]
    tops = graph.roots(df, "k", "p", "c").select("k", F.col("node").alias("root"))
    found = graph.paths(df.where("k = 0"), "k", "p", "c", tops).where("node = 'd'").select("path")
    assert sorted(r[0] for r in found.collect()) == [["a", "b", "c", "d"], ["a", "c", "d"]]
    ring = spark.createDataFrame([(0, "a", "b"), (0, "b", "a")], "k long, p string, c string")
    assert graph.paths(ring, "k", "p", "c").where("is_cycle").count() == 2


def test_tables_and_metadata(spark):
    spark.sql("DROP TABLE IF EXISTS made")
    create_table_as(spark.range(20).select("id", (F.col("id") % 3).alias("part")), "made", partitioned_by=["part"], clustered_by=["id"], buckets=2)
    assert spark.table("made").where("part = 1").count() == 7
    told = CatalogProvider(spark).table("made")
    assert [c["name"] for c in told["columns"]] == ["id", "part"] and CatalogProvider(spark).table("none") is None
    spark.sql("DROP TABLE made")


def test_corpus_is_written(spark, tmp_path):
    c = LineageAnalyzer().corpus_of(spark, ["SELECT a FROM t", "SELECT b FROM u"])
    write_corpus(c, str(tmp_path / "out"))
    assert all(spark.read.parquet(str(tmp_path / "out" / r)).count() >= 0 for r in RELATIONS if r != "cte_order")
    assert spark.read.parquet(str(tmp_path / "out/table_edges")).count() == 2


def test_stream_of_statements(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([(1, "SELECT a FROM t"), (2, "CREATE TABLE x AS SELECT a FROM y")], "stmt_id long, sql string").write.mode("append").parquet(str(source))
    read = spark.readStream.schema("stmt_id long, sql string").parquet(str(source))
    for _ in range(2):  # the second run finds nothing new
        assert stream_table_edges(read, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(90)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("stmt_id", "target", "source")) == [(1, "QUERY_RESULT", "t"), (2, "x", "y")]


def test_windows_on_a_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    read = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = windowed_counts(read).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert rows(spark.table("hours")) == rows(windowed_counts(spark.read.parquet(f"{sf}/events.parquet")))
