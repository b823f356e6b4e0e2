import pyspark.sql.functions as F

import corpus_pipeline
from siltstone.llm import decontaminate, minhash


def test_stages(spark, sf):
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        kept[name] = docs
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id", "left_semi")
    bad = before.join(labels.where("quality = 0"), "doc_id", "left_semi")
    assert good.join(kept["quality"], "doc_id", "left_anti").count() <= 1 and bad.join(kept["quality"], "doc_id", "left_semi").count() <= 1
    assert minhash.near_duplicates(kept["near-duplicates"]).where("not nd_kept").count() == 0
    found = decontaminate.scan(kept["decontamination"], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert found.where(F.exists("dc_spans", lambda s: s[1] - s[0] >= 10)).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_run(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "packing"]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_a_passage_is_cut_and_the_rest_stays(spark, tmp_path):
    passage = " ".join(f"b{k}" for k in range(12))
    own = " ".join(f"w{k}" for k in range(60))
    spark.createDataFrame([(1, passage)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"{own} {passage} end"), (2, own), (3, f"{passage} end")], "doc_id long, text string")
    left = {r[0]: r[1].split() for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()}
    assert left == {1: [*own.split(), "end"], 2: own.split()}


def test_repeated_rows_and_rows_without_an_id_leave_one_of_a_group(spark, sf):
    near = " ".join(f"w{k}" for k in range(80))
    rows = [(5, near), (5, near), (5, near + " end"), (9, near), (None, near + " more"), (None, "p q r s t u"), (None, "P q r s t u"), (None, "p q r s t u"), (7, "other text of this id"), (7, "other text of this id"), (7, "a second one"), (None, ""), (None, None), (8, ""), (8, ""), (3, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, nd_number string").repartition(3)
    left = corpus_pipeline.deduplicate(spark, docs, sf)
    assert left.columns == docs.columns
    got = sorted(((r[0], (r[1] or "").lower() if r[0] is None else r[1]) for r in left.collect()), key=str)
    assert got == sorted([(5, near), (5, near + " end"), (7, "other text of this id"), (7, "a second one"), (8, ""), (3, None), (None, ""), (None, ""), (None, "p q r s t u")], key=str)
    none = docs.where("doc_id is null and text <> ''")
    assert corpus_pipeline.deduplicate(spark, none, sf).count() == 2
    assert corpus_pipeline.deduplicate(spark, docs.limit(0), sf).count() == 0
