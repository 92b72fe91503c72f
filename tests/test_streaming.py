"""Streams give what the batch operators give."""

from helpers import revisions, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import fingerprint, history, orphans
from siltstone.streaming import folders
from siltstone.streaming import orphans as stream

DELTA = "target_table string, key string, refs int, rows int"


def test_orphans(spark, tmp_path):
    import os

    batches = [[("t", "a", 1, 0), ("t", "b", 1, 0), ("t", "b", 1, 0)], [("t", "b", 0, 1), ("t", "c", 0, 1)], [("t", "c", 0, -1), ("t", "a", -1, 0), ("t", "d", 1, 0)], [], [("t", "e", 1, 0)], [("t", "e", 0, 1)], [("t", "f", 1, 0)]]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(DELTA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert stream.read_state(spark, f"{tmp_path}/state") is None
    for i, b in enumerate(batches):
        spark.createDataFrame(b or [("t", "x", 0, 0)], DELTA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream.maintain_state(source, f"{tmp_path}/state", f"{tmp_path}/ck", merge_every=2).awaitTermination()
        every = orphans.apply_deltas(None, spark.createDataFrame(sum(batches[: i + 1], []), DELTA))
        assert rows(stream.read_state(spark, f"{tmp_path}/state")) == rows(every)
    assert rows(orphans.orphan_keys(stream.read_state(spark, f"{tmp_path}/state"))) == [("t", "d", 1), ("t", "f", 1)]
    # what has been merged is removed, but for one full version before the last
    assert sorted(n for n in os.listdir(tmp_path / "state") if n[1] == "=") == ["d=4", "d=5", "d=6", "v=3", "v=5"]
    q = stream.running_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts").filter("key = 'b'")) == [("t", "b", 2, 1)]


def test_folders(spark, tmp_path):
    d = history.all_data(revisions(spark, "o/r d/a h1 1", "o/r d/b h2 2", "o/r d/a - 3", "o/r e/c h3 3", "o/r d/a h4 5", "o/r d/b h9 6"))
    deltas = fingerprint.folder_deltas(d).persist()
    for i, (lo, hi) in enumerate(((0, 2), (3, 4), (5, 9))):
        deltas.filter(F.col("COMMIT_TIME").between(lo, hi)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(deltas.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = folders.running_states(source).writeStream.format("memory").queryName("states").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    w = Window.partitionBy(*folders.KEYS).orderBy("COMMIT_TIME")
    want = deltas.select(*folders.KEYS, "COMMIT_TIME", F.sum("_dh").over(w), F.sum("_dn").over(w), F.sum("_df").over(w))
    assert rows(spark.table("states")) == rows(want)
