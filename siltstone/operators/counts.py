"""Counts of live, original, copied, diverged and obsolete paths. Each gives a frame, never a number on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import history as H

PATH = H.PATH


def _at_head(df: DataFrame) -> DataFrame:
    return df.filter(F.col("COMMIT_TIME") == F.col("HEAD_COMMIT_TIME"))


def all_paths_count(data: DataFrame) -> DataFrame:
    """Paths whose head is a content."""
    return _at_head(data.filter(F.col("HASH_CODE").isNotNull())).select(*PATH).distinct().agg(F.count("*").alias("n_paths"))


def orig_paths_count(data: DataFrame) -> DataFrame:
    """Paths that are the origin of a content and have not changed since, by IS_UNIQUE."""
    return (
        H.orig(data)
        .filter(F.col("O_COMMIT_TIME") == F.col("O_HEAD_COMMIT_TIME"))
        .select("O_REPO_OWNER", "O_REPOSITORY", "O_GIT_PATH", "IS_UNIQUE")
        .distinct()
        .groupBy("IS_UNIQUE")
        .agg(F.count("*").alias("n_paths"))
    )


def copy_paths_count(data: DataFrame) -> DataFrame:
    """Paths whose head is a copy."""
    return H.head_copy(data).select(*PATH).distinct().agg(F.count("*").alias("n_paths"))


def divergent_copy_count(data: DataFrame) -> DataFrame:
    """Paths that held a copy once and are the unchanged origin of another content now, by that content's IS_UNIQUE."""
    diverged = H.copy(data).filter(F.col("COMMIT_TIME") != F.col("HEAD_COMMIT_TIME")).select(*PATH).distinct()
    heads = (
        H.orig(data)
        .filter(F.col("O_COMMIT_TIME") == F.col("O_HEAD_COMMIT_TIME"))
        .select(*[F.col(f"O_{c}").alias(c) for c in PATH], "IS_UNIQUE")
    )
    return diverged.join(heads, list(PATH)).groupBy("IS_UNIQUE").agg(F.count("*").alias("n_paths"))


def active_repo_obsolete_copy_count(data: DataFrame) -> DataFrame:
    """Paths at a copy whose origin has other content by now, by whether the copier's repository has a commit after that."""
    last = data.groupBy("REPO_OWNER", "REPOSITORY").agg(F.max("COMMIT_TIME").alias("REPO_LAST_COMMIT_TIME"))
    return (
        H.head_copy(data)
        .filter(F.col("O_HEAD_HASH_CODE") != F.col("HASH_CODE"))
        .join(last, ["REPO_OWNER", "REPOSITORY"])
        .select(*PATH, (F.col("REPO_LAST_COMMIT_TIME") > F.col("O_HEAD_COMMIT_TIME")).alias("IS_ACTIVE"))
        .distinct()
        .groupBy("IS_ACTIVE")
        .agg(F.count("*").alias("n_paths"))
    )
