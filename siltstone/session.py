"""The folder shared by all executors, and nothing else about the session."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a local one is set if all tasks run in this process (as in
    tests); on a cluster, whose executors would not see it, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through the Hadoop file system it belongs to; a missing path is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df, name: str):
    """The frame written once to the shared folder and read from there: cuts the lineage, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_state(spark: SparkSession, folder: str, number: int, state: dict) -> None:
    """Write ``state`` as version ``number`` of a folder's manifest. It is renamed into place, so that a reader sees it whole or not at
    all; the version before the last one is removed."""
    jvm = spark._jvm.org.apache.hadoop.fs
    part, final = jvm.Path(f"{folder}/_writing-{uuid.uuid4().hex}"), jvm.Path(f"{folder}/manifest-{number:09}.json")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if not fs.rename(part, final):
        raise OSError(f"{final} exists: the folder has another writer")
    remove(spark, f"{folder}/manifest-{number - 2:09}.json")


def load_state(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest version of a folder's manifest."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*.json")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    names = sorted(str(f.getPath().toString()) for f in found or [])
    if not names:
        raise FileNotFoundError(f"no manifest in {folder}")
    return int(names[-1][-14:-5]), json.loads(spark.read.text(names[-1], wholetext=True).first()[0])


def buckets_for(spark: SparkSession, rows: int, rows_each: int = 2_000_000) -> int:
    """A number of buckets by the rows they are to hold, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_each))


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, what is written is shuffled to ``n`` partitions: an aggregate over a table's bucket column then comes out in as many
    buckets, and needs no second shuffle."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)
