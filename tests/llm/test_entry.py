import __spark_entry__ as entry
from siltstone.llm import queries as llm


def test_all_are_registered():
    names = set(entry.queries())
    assert {q.split("_")[0] for q in llm.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(llm.QUERIES) | {"pipeline"} <= names and set(entry.oracle_sql()) <= names


def test_stages_bear_clashing_names(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.selectExpr("*", "1 AS qc_score", "'x' AS nd_gone", "2 AS node", "3 AS label", "4 AS id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sf)
        assert odd.columns == [*docs.columns, "qc_score", "nd_gone", "node", "label", "id"]
        odd = odd.cache()
    assert odd.count() > 0 and odd.where("qc_score <> 1 or nd_gone <> 'x' or id <> 4").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() > 0


def test_stages_bear_empty_tables(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
