import pyarrow as pa

from siltstone.llm import common


def test_slices_are_bounded_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (k % 50) for k in range(1000)]), pa.array(range(1000))], names=["t", "n"])
    parts = list(common.small(iter([batch, batch.slice(0, 0)]), limit=500))
    assert [n for p in parts for n in p.column(1).to_pylist()] == list(range(1000)) and max(p.num_rows for p in parts) < 40
    assert sum(p.num_rows for p in common.small(iter([batch.slice(0, 1)]), limit=1)) == 1


def test_scratch_is_shared_and_swept(spark):
    scratch = common.Scratch(spark, "common-test")
    assert scratch.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept, gone = scratch.save(spark.range(5), "kept"), scratch.save(spark.range(5), "gone")
    assert kept.count() == 5
    scratch.drop(gone)
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))
    assert there(kept._scratch_path) and not there(gone._scratch_path)
    common.sweep(spark)
    assert not there(scratch.root)


def test_nothing_here_uses_local_checkpoints():
    from pathlib import Path

    root = Path(common.__file__).parents[1]
    assert not [f for f in root.rglob("*.py") if "localCheckpoint(" in f.read_text()]
