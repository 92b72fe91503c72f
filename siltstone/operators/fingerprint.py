"""Additive fingerprints of folder states, kept up to date from commit to commit.

A folder's state is (sum of content checksums, sum of name checksums, number of files). Each revision adds a delta, so the
state at a commit is a running sum and set equality of folders becomes equality of three integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.paths import file_name, parent_folder
from siltstone.operators import history as H
from siltstone.operators import scan
from siltstone.session import materialise

SUMS = ("sum_hash_crc", "sum_name_crc", "n_files")


def candidates(data: DataFrame) -> DataFrame:
    """Revisions whose owner and whose repository name each occur among the origins of head copies, not as a pair."""
    heads = H.head_copy(data)
    owners = heads.select(F.col("O_REPO_OWNER").alias("REPO_OWNER")).distinct()
    names = heads.select(F.col("O_REPOSITORY").alias("REPOSITORY")).distinct()
    return data.join(owners, "REPO_OWNER", "left_semi").join(names, "REPOSITORY", "left_semi")


def folder_deltas(revisions: DataFrame) -> DataFrame:
    """What each (repository, time, folder) adds to the three sums. A path added again after a deletion counts as added;
    a second deletion in a row changes nothing. A path's revisions are ordered by COMMIT_TIME, then COMMIT_ID where the frame has
    it (``all_data(..., with_commit=True)``), then hash."""
    c = F.col
    commit = ["COMMIT_ID"] if "COMMIT_ID" in revisions.columns else []
    # written once, as keys are counted first
    written = materialise(revisions.select(*H.BASE, *commit, F.crc32("HASH_CODE").alias("_crc")), "revisions")
    rows = (
        scan.previous_of_each(written, H.PATH, ("COMMIT_TIME", *commit, "HASH_CODE"), "_crc", "_prev")
        .select(
            "REPO_OWNER",
            "REPOSITORY",
            "COMMIT_TIME",
            parent_folder(c("GIT_PATH")).alias("FOLDER"),
            (F.coalesce("_crc", F.lit(0)) - F.coalesce("_prev", F.lit(0))).alias("_dh"),
            (F.when(c("_prev").isNull(), 1).otherwise(0) - F.when(c("_crc").isNull(), 1).otherwise(0)).alias("_sign"),
            F.coalesce(F.crc32(file_name(c("GIT_PATH"))), F.lit(0)).alias("_name"),
        )
    )
    return rows.groupBy("REPO_OWNER", "REPOSITORY", "COMMIT_TIME", "FOLDER").agg(
        F.sum("_dh").alias("_dh"), F.sum(c("_sign") * c("_name")).alias("_dn"), F.sum("_sign").alias("_df")
    )


def ranked_orig_folder_hash(data: DataFrame, max_rank: int | None = None) -> DataFrame:
    """Distinct states of folders with at least one file, at the first time each held, ranked among all folders with the
    same state by time, owner, repository and folder. With ``max_rank`` only states up to that rank, which the planner then
    picks before the shuffle; without it a state of very many folders is ranked in blocks."""
    deltas = materialise(folder_deltas(candidates(data)), "deltas")
    states = (
        scan.running_of_each(deltas, ("REPO_OWNER", "REPOSITORY", "FOLDER"), ("COMMIT_TIME",), dict(zip(SUMS, ("_dh", "_dn", "_df"))))
        .filter("n_files > 0")
        .groupBy(*[F.col(c).alias(f"O_{c}") for c in ("REPO_OWNER", "REPOSITORY", "FOLDER")], *SUMS)
        .agg(F.min("COMMIT_TIME").alias("O_COMMIT_TIME"))
    )
    order = ("O_COMMIT_TIME", "O_REPO_OWNER", "O_REPOSITORY", "O_FOLDER")
    if max_rank is None:
        return scan.ranked_of_each(materialise(states, "states"), SUMS, order, "ROW_NUM")
    rank = F.row_number().over(Window.partitionBy(*SUMS).orderBy(*order))
    return states.withColumn("ROW_NUM", rank).filter(F.col("ROW_NUM") <= max_rank)


def copy_folder_hash(data: DataFrame) -> DataFrame:
    """The copier's side: head copies that landed in one folder at one time, with the same three sums."""
    distinct = H.head_copy(data).select("REPO_OWNER", "REPOSITORY", "GIT_PATH", "COMMIT_TIME", F.crc32("HASH_CODE").alias("_crc")).distinct()
    name = F.crc32(file_name(F.col("GIT_PATH")))
    return distinct.groupBy("REPO_OWNER", "REPOSITORY", "COMMIT_TIME", parent_folder(F.col("GIT_PATH")).alias("FOLDER")).agg(
        F.sum("_crc").alias(SUMS[0]), F.sum(name).alias(SUMS[1]), F.count(name).alias(SUMS[2])
    )
