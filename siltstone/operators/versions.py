"""Problem 3: the history of an entity's attribute as versions with the period each was valid (gaps and islands).

A comparison with the previous row marks changes, a running sum of the marks numbers the islands, and the least time of an
island with the start of the next gives its period. Rows are shuffled once, by entity, and everything else runs where they lie.

An entity may hold any share of the rows. Those of more than ``heavy`` rows are counted out first and go another way: their time
line is cut into blocks of 2**20 seconds, of at most so many rows as only one row per second holds; islands are found block by
block, and one row per entity and block takes part in the two steps across blocks. The result is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id
from siltstone.operators.history import PATH, same
from siltstone.operators.skew import sent_if_small
from siltstone.session import materialise

BLOCK_BITS = 20
HEAVY_ROWS = 1 << 20


def _in_one_place(rows: DataFrame, entity: list[str], restated: bool) -> DataFrame:
    """Versions of entities whose rows fit one task each: (entity, _a, _from, _next)."""
    c = F.col
    rows = rows.repartition(*entity)
    if restated:
        rows = rows.groupBy(*entity, "_tie", "_a").agg(F.min("_t").alias("_t"))
    by_tie = Window.partitionBy(*entity).orderBy("_t", "_tie", "_a")
    by_time = Window.partitionBy(*entity).orderBy("_t")
    # of the rows of one second the last by tie and attribute holds
    held = rows.withColumn("_then", F.lead("_t").over(by_tie)).filter(c("_then").isNull() | (c("_then") != c("_t"))).select(*entity, "_t", "_a")
    first = F.lag("_t").over(by_time).isNull()
    marked = held.withColumn("_change", F.when(first | ~c("_a").eqNullSafe(F.lag("_a").over(by_time)), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_change").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy(*entity, "_island").agg(F.min("_t").alias("_from"), F.max("_a").alias("_a"))
    return islands.withColumn("_next", F.lead("_from").over(Window.partitionBy(*entity).orderBy("_island"))).select(*entity, "_a", "_from", "_next")


def _in_blocks(rows: DataFrame, entity: list[str], restated: bool) -> DataFrame:
    """The same for entities of any number of rows."""
    c = F.col
    if restated:
        rows = rows.groupBy(*entity, "_tie", "_a").agg(F.min("_t").alias("_t"))
    rows = (
        rows.groupBy(*entity, "_t")
        .agg(F.max(F.struct("_tie", "_a")).alias("_r"))
        .select(*entity, "_t", c("_r._a").alias("_a"), F.shiftright("_t", BLOCK_BITS).alias("_b"))
    )
    rows = materialise(rows, "snapshots")  # read for the rows and for the blocks
    inside = Window.partitionBy(*entity, "_b").orderBy("_t")
    blocks = Window.partitionBy(*entity).orderBy("_b")
    # the attribute that held when the block began
    before = (
        rows.groupBy(*entity, "_b")
        .agg(F.max(F.struct("_t", "_a")).alias("_last"))
        .select(*entity, "_b", F.lag(F.struct(c("_last._a").alias("_a"))).over(blocks).alias("_prev"))
    )
    marked = (
        rows.withColumn("_n", F.row_number().over(inside))
        .withColumn("_lag", F.lag("_a").over(inside))
        .alias("r")
        .join(before.alias("p"), same("r", "p", (*entity, "_b")))
        .select(
            "r.*",
            F.when((c("_n") == 1) & c("_prev").isNull(), True)
            .otherwise(~c("_a").eqNullSafe(F.when(c("_n") == 1, c("_prev._a")).otherwise(c("_lag"))))
            .cast("int")
            .alias("_change"),
        )
    )
    islands = (
        marked.withColumn("_island", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("_island > 0")  # rows before a block's first change belong to an island of an earlier block
        .groupBy(*entity, "_b", "_island")
        .agg(F.min("_t").alias("_from"), F.max("_a").alias("_a"))
    )
    islands = materialise(islands, "islands")
    # the first change of any later block
    later = (
        islands.groupBy(*entity, "_b")
        .agg(F.min("_from").alias("_first"))
        .select(*entity, "_b", F.lead("_first").over(blocks).alias("_later"))
    )
    following = F.lead("_from").over(Window.partitionBy(*entity, "_b").orderBy("_from"))
    joined = islands.withColumn("_next", following).alias("r").join(later.alias("p"), same("r", "p", (*entity, "_b")))
    return joined.select(*[c(f"r.{e}").alias(e) for e in entity], "_a", "_from", F.coalesce("_next", "_later").alias("_next"))


def attribute_versions(snapshots: DataFrame, entity: Sequence[str], attribute: str, time: str, tie: str, restated: bool = False, heavy: int = HEAVY_ROWS) -> DataFrame:
    """``entity``, ``attribute``, valid_from, valid_to of every version.

    ``time`` holds whole seconds. Of several rows of an entity at one time that with the greatest ``tie`` holds, then that with
    the greatest attribute; nulls are least. Rows with a null time are no snapshots and are left out. A null attribute says
    that the entity does not exist: it ends a version and is none. valid_to is -1 for a version that still holds. Null entity
    columns are values like others. Repeated rows change nothing; other columns are ignored; no rows give no versions. With
    ``restated``, of rows that differ in nothing but time only that with the least time counts."""
    c = F.col
    names = [f"_e{i}" for i in range(len(entity))]
    rows = snapshots.filter(c(time).isNotNull()).select(*[c(e).alias(n) for e, n in zip(entity, names)], c(time).alias("_t"), c(tie).alias("_tie"), c(attribute).alias("_a"))
    # 64-bit hashes serve to count only: two entities under one are at worst both taken as heavy
    number = F.xxhash64(*names)
    counts = rows.groupBy(number.alias("_k")).agg(F.count("*").alias("_n"))
    many = materialise(counts.filter(c("_n") > heavy).select("_k"), "heavy-entities")
    if many.isEmpty():
        found = _in_one_place(rows, names, restated)
    else:  # at most one in ``heavy`` rows
        keyed, many = rows.withColumn("_k", number), sent_if_small(many)
        found = _in_one_place(keyed.join(many, "_k", "left_anti").drop("_k"), names, restated).unionByName(_in_blocks(keyed.join(many, "_k", "left_semi").drop("_k"), names, restated))
    return found.filter(c("_a").isNotNull()).select(*[c(n).alias(e) for e, n in zip(entity, names)], c("_a").alias(attribute), c("_from").alias("valid_from"), F.coalesce("_next", F.lit(-1)).alias("valid_to"))


def path_versions(file_metadata: DataFrame) -> DataFrame:
    """Versions of each path's content. Identifiers are brought to normal form, a null or blank hash is a deletion, and of
    rows that differ only in commit_time (or row_id and loaded_at) the least commit_time holds."""
    rows = file_metadata.select("repo_owner", "repository", "git_path", hex_id("hash_code").alias("hash_code"), "commit_time", hex_id("commit_id").alias("commit_id"))
    return attribute_versions(rows, [p.lower() for p in PATH], "hash_code", "commit_time", "commit_id", restated=True)


def versions_at(versions: DataFrame, when: int) -> DataFrame:
    """The versions that hold at one time."""
    return versions.filter((F.col("valid_from") <= when) & ((F.col("valid_to") > when) | (F.col("valid_to") == -1)))
