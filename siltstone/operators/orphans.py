"""Problem 7: references to rows that do not exist, kept as signed counts per key.

Every change is a delta: a reference gained or lost, a target row that appeared or was withdrawn. Per key the deltas sum up to
a number of references and a number of existing rows; keys with references and without rows are the orphans. A state can be
kept and brought up to date by adding new deltas to it; late targets heal and withdrawals break references by themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id
from siltstone.operators.skew import heavy_semi_join
from siltstone.session import materialise

#: (target table, its key, the referring column, whether a null reference is one to nothing and so an orphan)
TARGETS = (("commit_messages", "commit_id", "commit_id", True), ("contents", "hash_code", "hash_code", False))
#: The rows of a key with more references than this are not shuffled.
HEAVY_REFS = 200_000


def references(file_metadata: DataFrame) -> DataFrame:
    """A row (target_table, key, row_id, commit_time) per reference. A null or blank commit id refers to nothing that can
    exist (key ''); a null or blank hash is a deletion and no reference."""
    parts = []
    for target, _, column, required in TARGETS:
        key = F.coalesce(hex_id(column), F.lit("")) if required else hex_id(column)
        parts.append(F.struct(F.lit(target).alias("target_table"), key.alias("key")))
    return file_metadata.select("row_id", "commit_time", F.inline(F.array(*parts))).filter(F.col("key").isNotNull())


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """+1 reference per row, or -1 for rows that were removed."""
    return refs.select("target_table", "key", F.lit(sign).alias("refs"), F.lit(0).alias("rows"))


def existence_deltas(table: DataFrame, target: str, key: str) -> DataFrame:
    """+1 for each row's arrival and -1 for its withdrawal; null and blank keys never exist."""
    withdrawn = F.when(F.col("deleted_at").isNotNull(), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    return (
        table.select(F.lit(target).alias("target_table"), hex_id(key).alias("key"), F.lit(0).alias("refs"), F.explode(withdrawn).alias("rows"))
        .filter(F.col("key").isNotNull())
    )


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The state (target_table, key, refs, rows) after the deltas. Sums combine before the shuffle, so hot keys weigh nothing;
    keys whose counts are both zero leave the state."""
    every = [*([state] if state is not None else []), *deltas]
    total = reduce(lambda a, b: a.unionByName(b), every).groupBy("target_table", "key").agg(F.sum("refs").alias("refs"), F.sum("rows").alias("rows"))
    return total.filter((F.col("refs") != 0) | (F.col("rows") != 0))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return state.filter((F.col("refs") > 0) & (F.col("rows") <= 0)).select("target_table", "key", "refs")


def reference_state(file_metadata: DataFrame, commit_messages: DataFrame, contents: DataFrame) -> DataFrame:
    """The state after all deltas of the three tables."""
    tables = {"commit_messages": commit_messages, "contents": contents}
    return apply_deltas(None, reference_deltas(references(file_metadata)), *[existence_deltas(tables[t], t, k) for t, k, _, _ in TARGETS])


def heavy_references(state: DataFrame, heavy: int = HEAVY_REFS) -> DataFrame:
    """Keys with more than ``heavy`` references, at most one in so many rows, and whether they are orphans (found)."""
    return state.filter(F.col("refs") > heavy).select("target_table", "key", (F.col("rows") <= 0).alias("found"))


def orphan_rows(refs: DataFrame, state: DataFrame, heavy: int = HEAVY_REFS) -> DataFrame:
    """The referring rows of the orphan keys of a state of these references, written beforehand. A key, orphan or not, may be
    referred to by a large part of all rows."""
    return heavy_semi_join(refs, orphan_keys(state), materialise(heavy_references(state, heavy), "heavy-references"), ["target_table", "key"])


def orphan_report(refs: DataFrame, state: DataFrame) -> DataFrame:
    """Orphan references and distinct orphan keys per target table and month (UTC) of commit_time, beside all references of that
    month. A null commit_time has a null month."""
    month = lambda d: d.withColumn("month", F.date_format(F.timestamp_seconds("commit_time"), "yyyy-MM"))
    total = month(refs).groupBy("target_table", "month").agg(F.count("*").alias("n_references"))
    lost = month(orphan_rows(refs, state)).groupBy("target_table", "month", "key").agg(F.count("*").alias("_n")).groupBy("target_table", "month").agg(F.sum("_n").alias("n_orphans"), F.count("*").alias("n_orphan_keys"))
    return (
        total.alias("t")
        .join(lost.alias("l"), (F.col("t.target_table") == F.col("l.target_table")) & F.col("t.month").eqNullSafe(F.col("l.month")), "left")
        .select("t.target_table", "t.month", "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_orphan_keys", F.lit(0)).alias("n_orphan_keys"))
    )
