"""Problem 7 on streams: reference and existence counts kept by Structured Streaming as deltas arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.orphans import apply_deltas
from siltstone.session import remove

STATE = "target_table string, key string, refs long, rows long"
MERGE_EVERY = 10


def running_counts(deltas: DataFrame) -> DataFrame:
    """A stream (target_table, key, refs, rows) of signed deltas to the counts of each key, for the update or complete mode.
    Partial sums are combined before the state store, which keeps two numbers per key; order and lateness do not matter."""
    return deltas.groupBy("target_table", "key").agg(F.sum("refs").alias("refs"), F.sum("rows").alias("rows"))


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state that ``maintain_state`` has left in ``path``: its last full version and the deltas since; None if there is none."""
    full, deltas = _versions(spark, path)
    if not full and not deltas:
        return None
    last = full[-1] if full else -1
    parts = [f"{path}/v={v}" for v in full[-1:]] + [f"{path}/d={n}" for n in deltas if n > last]
    return apply_deltas(None, spark.read.schema(STATE).parquet(*parts))


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the full versions and of the deltas that were written to the end, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = [f.getPath().getParent().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]
    return tuple(sorted(int(n[2:]) for n in found if n.startswith(kind)) for kind in ("v=", "d="))


def maintain_state(deltas: DataFrame, path: str, checkpoint: str, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Keep the state of ``apply_deltas`` in ``path``, to be read by ``read_state``.

    A batch writes no more than its own deltas, summed per key, as ``d=<batch>``. Every ``merge_every`` batches they are merged with the
    last full version into the next, ``v=<batch>``, and what that replaces is removed but for the full version before it, which
    readers may still have open. A batch that is run again after a failure writes the same files."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        apply_deltas(None, batch.select("target_table", "key", "refs", "rows")).write.mode("overwrite").parquet(f"{path}/d={number}")
        if (number + 1) % merge_every:
            return
        full, parts = _versions(spark, path)
        base = [v for v in full if v < number]
        source = [f"{path}/v={v}" for v in base[-1:]] + [f"{path}/d={n}" for n in parts if n > (base[-1] if base else -1)]
        apply_deltas(None, spark.read.schema(STATE).parquet(*source)).write.mode("overwrite").parquet(f"{path}/v={number}")
        for old in base[:-1]:
            remove(spark, f"{path}/v={old}")
        for n in parts:
            if base and n <= base[-1]:
                remove(spark, f"{path}/d={n}")

    return deltas.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
