"""Problem 6: ordered results per key although a few keys hold most rows.

Rows are range-partitioned on (key, order, row) by quantiles that Spark samples, so that partitions are equal in rows and a heavy
key, even at one point of the order, is spread over as many of them as it needs. Each partition folds its sorted rows into one
state per key; the states of a key that was split are then stitched at their boundaries. A key gives at most two states per
partition, one of them for rows without a place in the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id

HEAVY_SHARE = 0.05
SALTS = 16
#: Tables are sent to all executors up to so many rows, which are counted first.
BROADCAST_ROWS = 250_000
STATE = "field_name string, key_value string, first_at long, last_at long, n_rows long, longest_gap long"
_ARROW = pa.schema([("field_name", pa.string()), ("key_value", pa.string()), *[(c, pa.int64()) for c in ("first_at", "last_at", "n_rows", "longest_gap")]])


def sent_if_small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``written``, marked to be sent to all executors if it has at most ``rows`` narrow rows; else it is joined by shuffling."""
    return F.broadcast(written) if written.count() <= rows else written


def _runs(batch: pa.RecordBatch) -> list[tuple]:
    """States of the runs of equal keys in a sorted batch. Rows without a time lead and are a run of their own."""
    f, k, t = (batch.column(i) for i in range(3))
    n = batch.num_rows
    known = pc.is_valid(t).to_numpy(zero_copy_only=False)
    t = pc.fill_null(t, 0).to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = pc.or_(pc.not_equal(f[1:], f[:-1]), pc.not_equal(k[1:], k[:-1])).to_numpy(zero_copy_only=False) | (known[1:] != known[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    gaps = np.zeros(n, np.int64)
    gaps[1:] = np.where(new[1:], 0, t[1:] - t[:-1])
    at = pa.array(starts)
    timed = known[starts]
    first, last = ([int(v) if ok else None for v, ok in zip(t[i], timed)] for i in (starts, ends - 1))
    return list(zip(f.take(at).to_pylist(), k.take(at).to_pylist(), first, last, (ends - starts).tolist(), np.maximum.reduceat(gaps, starts).tolist()))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per key of a sorted partition; a run that goes on in the next batch is carried over."""
    open_state = None
    for b in batches:
        if not b.num_rows:
            continue
        states = _runs(b)
        if open_state is not None:
            if states[0][:2] == open_state[:2] and (states[0][2] is None) == (open_state[2] is None):
                _, _, first, last, n, gap = open_state
                f, k, first2, last2, n2, gap2 = states[0]
                states[0] = (f, k, first, last2, n + n2, max(gap, gap2, 0 if last is None else first2 - last))
            else:
                states.insert(0, open_state)
        open_state = states.pop()
        if states:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*states), _ARROW.types)], schema=_ARROW)
    if open_state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(open_state, _ARROW.types)], schema=_ARROW)


def spread_by_key(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """``rows`` (field_name, key_value, at, row) in partitions about equal in rows, ranges of those columns in this order."""
    cols = ("field_name", "key_value", "at", "row")
    return rows.repartitionByRange(partitions, *cols) if partitions else rows.repartitionByRange(*cols)


def per_key(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """``rows`` (field_name, key_value, at, and row, a number that tells apart rows of one key at one time): for each key the
    number of rows, the first and last ``at`` and the longest gap between rows that follow each other (0 for a single row),
    whatever the key's share of the rows, at one time too.

    Rows with a null field or key are left out. Rows with a null ``at`` count, but have no part in first, last and gap, which
    are null, null and 0 where a key has no others. A null ``row`` is a value like others; other columns are ignored. No rows
    give no result."""
    rows = rows.select("field_name", "key_value", "at", "row").dropna(subset=["field_name", "key_value"])
    states = spread_by_key(rows, partitions).sortWithinPartitions("field_name", "key_value", "at").drop("row").mapInArrow(_fold, STATE)
    before = F.lag("last_at").over(Window.partitionBy("field_name", "key_value").orderBy("first_at", "last_at"))
    return (
        states.withColumn("_gap", F.coalesce(F.col("first_at") - before, F.lit(0)))
        .groupBy("field_name", "key_value")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.max(F.greatest("longest_gap", "_gap")).alias("longest_gap"),
        )
    )


def revision_keys(file_metadata: DataFrame) -> DataFrame:
    """Owner, repository and hash of each row of file_metadata as rows of (field_name, key_value, at, row). Owners and
    repositories count as written, hashes in normal form; blank values are left out, like nulls."""
    exact = lambda c: F.when(F.trim(c) != "", F.col(c))
    parts = [F.struct(F.lit(f).alias("field_name"), v.alias("key_value")) for f, v in (("repo_owner", exact("repo_owner")), ("repository", exact("repository")), ("hash_code", hex_id("hash_code")))]
    return file_metadata.select(F.col("commit_time").alias("at"), F.col("row_id").alias("row"), F.inline(F.array(*parts))).filter(F.col("key_value").isNotNull())


def heavy_keys(results: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold at least ``share`` of their field's rows. The totals are a few rows, one per field."""
    totals = results.groupBy("field_name").agg(F.sum("n_rows").alias("_total"))
    return results.join(F.broadcast(totals), "field_name").filter(F.col("n_rows") >= share * F.col("_total")).drop("_total")


def salted_semi_join(rows: DataFrame, keys: DataFrame, on: list[str], spread: list[str], salts: int = SALTS) -> DataFrame:
    """The rows whose ``on`` columns occur in ``keys``. Each key, which should be few or narrow, is repeated once per salt, and the
    rows of a key are spread over the salts by a hash of their ``spread`` columns, so that no key's rows meet in one task. Null
    keys match nothing."""
    repeated = keys.select(*on).distinct().select(*on, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return salted.join(repeated, [*on, "_salt"], "left_semi").select(*rows.columns)


def heavy_semi_join(rows: DataFrame, keys: DataFrame, heavy: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose ``on`` columns occur in ``keys``. ``heavy`` (``on``, and found: whether it is in ``keys``) lists the keys that
    very many rows have, written beforehand: their rows are settled by a list sent to all executors and never shuffled, the
    others by one shuffle, unsalted. Null keys match nothing."""
    if heavy.isEmpty():
        return rows.join(keys.select(*on).distinct(), on, "left_semi")
    told = rows.join(sent_if_small(heavy.select(*on, F.col("found").alias("_found"))), on, "left").select(*rows.columns, "_found")
    return told.filter("_found").drop("_found").unionByName(told.filter("_found IS NULL").drop("_found").join(keys.select(*on).distinct(), on, "left_semi"))
