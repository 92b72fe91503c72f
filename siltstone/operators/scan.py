"""Ordered per-key results (previous value, running sum, rank) over keys of any size.

Keys of at most HEAVY_ROWS rows, all but a few, are shuffled once and take plain windows. Those of more are counted out first. A
heavy key's rows are cut into blocks that follow each other in the order, a plain window runs inside each (key, block), and one row per
block is carried from block to block, so that a key that holds a third of all rows still spreads over all tasks. ``time_block`` cuts by time; ``range_block`` by sampled quantiles where times do not bound a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.history import same
from siltstone.operators.skew import sent_if_small
from siltstone.session import materialise

BLOCK_BITS = 20
HEAVY_ROWS = 1 << 20


def time_block(time: str) -> Column:
    """Blocks of 2**20 seconds."""
    return F.shiftright(F.col(time), BLOCK_BITS)


def range_block(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_block``, its partition after range partitioning by key and order. It is written once, as the cuts come from
    a sample and must be the same wherever they are used."""
    spread = df.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id())
    return materialise(spread, "range-blocks")


def _carry(rows: DataFrame, keys: Sequence[str], summaries: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """``rows`` with the ``carried`` columns, which windows over the blocks' ``summaries`` give for each block."""
    per_block = rows.groupBy(*keys, "_block").agg(*[v.alias(n) for n, v in summaries.items()])
    per_block = per_block.select(*keys, "_block", *[v.alias(n) for n, v in carried.items()])
    return rows.alias("r").join(per_block.alias("b"), same("r", "b", (*keys, "_block"))).select("r.*", *[f"b.{n}" for n in carried])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` (with ``_block``) and the value of the row before, null for a key's first row."""
    blocks = Window.partitionBy(*keys).orderBy("_block")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    last = F.max(F.struct(*order, F.col(value).alias("_v")))
    rows = df.withColumn("_nth", F.row_number().over(inside)).withColumn(name, F.lag(value).over(inside))
    out = _carry(rows, keys, {"_last": last}, {"_before": F.lag("_last._v").over(blocks)})
    return out.withColumn(name, F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col(name))).drop("_nth", "_before")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` (with ``_block``) and, for each name in ``sums``, the sum of its column over the key's rows so far."""
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select("*", *[F.sum(v).over(inside).alias(n) for n, v in sums.items()])
    out = _carry(rows, keys, {f"_t{n}": F.sum(v) for n, v in sums.items()}, {f"_p{n}": F.coalesce(F.sum(f"_t{n}").over(blocks), F.lit(0)) for n in sums})
    return out.withColumns({n: F.col(n) + F.col(f"_p{n}") for n in sums}).drop(*[f"_p{n}" for n in sums])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` (with ``_block``) and each row's number within its key."""
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(name, F.row_number().over(inside))
    out = _carry(rows, keys, {"_n": F.count("*")}, {"_p": F.coalesce(F.sum("_n").over(blocks), F.lit(0))})
    return out.withColumn(name, (F.col(name) + F.col("_p")).cast("int")).drop("_p")


def split_heavy(df: DataFrame, keys: Sequence[str], heavy: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of at most ``heavy`` rows, and those of others, None if there are none. ``df`` is read twice."""
    number = F.xxhash64(*keys)  # to count only: two keys under one number are at worst both taken as heavy
    many = df.groupBy(number.alias("_k")).agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy).select("_k")
    many = materialise(many, "heavy-keys")
    if many.isEmpty():
        return df, None
    keyed, many = df.withColumn("_k", number), sent_if_small(many)
    return keyed.join(many, "_k", "left_anti").drop("_k"), keyed.join(many, "_k", "left_semi").drop("_k")


def _either(df: DataFrame, keys: Sequence[str], heavy: int, plain: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame], blocked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    few, many = split_heavy(df, keys, heavy)
    out = plain(few)
    return out if many is None else out.unionByName(blocked(cut(many)).drop("_block"))


def _timed(df: DataFrame) -> DataFrame:
    return materialise(df.withColumn("_block", time_block("COMMIT_TIME")), "time-blocks")


def previous_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, heavy: int = HEAVY_ROWS) -> DataFrame:
    """``df`` and the value of the key's row before, null for its first. The order begins with COMMIT_TIME."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return _either(df, keys, heavy, lambda d: d.withColumn(name, F.lag(value).over(w)), _timed, lambda d: previous(d, keys, order, value, name))


def running_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], heavy: int = HEAVY_ROWS) -> DataFrame:
    """``df`` and, for each name in ``sums``, the sum of its column over the key's rows so far. The order begins with COMMIT_TIME."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _either(df, keys, heavy, lambda d: d.withColumns({n: F.sum(v).over(w) for n, v in sums.items()}), _timed, lambda d: running(d, keys, order, sums))


def ranked_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, heavy: int = HEAVY_ROWS) -> DataFrame:
    """``df`` and each row's number within its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return _either(df, keys, heavy, lambda d: d.withColumn(name, F.row_number().over(w)), lambda d: range_block(d, keys, order), lambda d: ranked(d, keys, order, name))
