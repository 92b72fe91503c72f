"""Folders copied whole from another repository, and what is counted about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.paths import FOLDER_LABELS, IMPORT_LABELS, label, path_components
from siltstone.operators import fingerprint as P
from siltstone.operators import history as H

RANKS = 100
POPULAR = 1000


def match_imports(copies: DataFrame, origins: DataFrame, max_rank: int = RANKS) -> DataFrame:
    """Each copied folder with the origin of least ROW_NUM (up to ``max_rank``) that has the same state, is strictly
    earlier and lies in another repository; null origin columns where there is none.

    One left join whose right side has at most ``max_rank`` rows per state, reduced by a combining aggregate."""
    c = F.col
    keys = ("REPO_OWNER", "REPOSITORY", "COMMIT_TIME", "FOLDER", *P.SUMS)
    o = origins.filter(c("ROW_NUM") <= max_rank)
    on = (
        (c("c.sum_hash_crc") == c("o.sum_hash_crc"))
        & (c("c.sum_name_crc") == c("o.sum_name_crc"))
        & (c("c.n_files") == c("o.n_files"))
        & (c("c.COMMIT_TIME") > c("o.O_COMMIT_TIME"))
        & ((c("c.REPO_OWNER") != c("o.O_REPO_OWNER")) | (c("c.REPOSITORY") != c("o.O_REPOSITORY")))
    )
    found = F.struct("o.ROW_NUM", "o.O_REPO_OWNER", "o.O_REPOSITORY", "o.O_FOLDER", "o.O_COMMIT_TIME")
    joined = copies.alias("c").join(o.alias("o"), on, "left").select(*[f"c.{k}" for k in keys], F.when(c("o.ROW_NUM").isNotNull(), found).alias("_m"))
    return joined.groupBy(*keys).agg(F.min("_m").alias("_m")).select(*keys, "_m.O_REPO_OWNER", "_m.O_REPOSITORY", "_m.O_FOLDER", "_m.O_COMMIT_TIME", "_m.ROW_NUM")


def copy_as_import_examples(data: DataFrame, max_rank: int = RANKS) -> DataFrame:
    """``match_imports`` over the folders of a lake."""
    return match_imports(P.copy_folder_hash(data), P.ranked_orig_folder_hash(data, max_rank), max_rank)


def copy_as_import_count(examples: DataFrame) -> DataFrame:
    """Copied files by package manager and by whether their folder's origin was found, ordered."""
    return (
        examples.select("REPO_OWNER", "REPOSITORY", "FOLDER", "n_files", F.col("O_REPO_OWNER").isNotNull().alias("IS_COPY_AS_IMPORT"))
        .distinct()
        .groupBy("IS_COPY_AS_IMPORT", label(F.col("FOLDER"), IMPORT_LABELS).alias("PACKAGER_MANAGER_NAME"))
        .agg(F.sum("n_files").alias("n_files"))
        .orderBy("IS_COPY_AS_IMPORT", "PACKAGER_MANAGER_NAME")
    )


def popular_other_folders(examples: DataFrame, threshold: int = POPULAR) -> DataFrame:
    """Folder names that occur more than ``threshold`` times in copied folders of no package manager."""
    return (
        examples.select("REPO_OWNER", "REPOSITORY", "FOLDER", "n_files")
        .distinct()
        .filter(label(F.col("FOLDER"), FOLDER_LABELS) == "OTHERS")
        .select(F.explode(path_components(F.col("FOLDER"))).alias("FOLDER"))
        .groupBy("FOLDER")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > threshold)
        .orderBy(F.desc("n"), "FOLDER")
    )


def unidentified_node_copies(data: DataFrame, examples: DataFrame, only_matched: bool = True) -> DataFrame:
    """Head copies below node_modules in repositories without an example. As every repository with a head copy has an
    example, matched or not, the literal reading (``only_matched=False``) is always empty."""
    seen = examples.filter(F.col("O_REPO_OWNER").isNotNull()) if only_matched else examples
    return (
        H.head_copy(data)
        .filter(F.col("GIT_PATH").contains("node_modules/"))
        .select(*H.PATH)
        .distinct()
        .join(seen.select("REPO_OWNER", "REPOSITORY").distinct(), ["REPO_OWNER", "REPOSITORY"], "left_anti")
    )
