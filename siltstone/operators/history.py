"""Lineage of file revisions: the head state of a path, the origin of a content, and the views that follow from them.

Both enrichments are grouped aggregates joined back rather than windows. The aggregates combine before the shuffle, so a
path or a hash that holds a third of all rows costs one row per input partition there, and in the join the adaptive plan
may split it. Deletions (null hash) never enter the second join; nothing reads the origin of a deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH = ("REPO_OWNER", "REPOSITORY", "GIT_PATH")
BASE = (*PATH, "HASH_CODE", "COMMIT_TIME")
HEAD = ("HEAD_COMMIT_TIME", "HEAD_HASH_CODE")
ORIGIN = ("O_REPO_OWNER", "O_REPOSITORY", "O_GIT_PATH", "O_COMMIT_TIME", "O_HEAD_HASH_CODE", "O_HEAD_COMMIT_TIME")


def same(a: str, b: str, keys: tuple[str, ...]) -> Column:
    """Null-safe equality of the keys of two aliased sides."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def with_head(fm: DataFrame) -> DataFrame:
    """Adds HEAD_COMMIT_TIME and HEAD_HASH_CODE: those of the path's last revision (of several at one time that with the
    greatest COMMIT_ID, then hash, a null being least). A head hash of null says that the path is deleted."""
    last = F.max(F.struct("COMMIT_TIME", "COMMIT_ID", "HASH_CODE"))
    heads = fm.groupBy(*PATH).agg(last.alias("_h"))
    return (
        fm.alias("r")
        .join(heads.alias("h"), same("r", "h", PATH))
        .select("r.*", F.col("_h.COMMIT_TIME").alias("HEAD_COMMIT_TIME"), F.col("_h.HASH_CODE").alias("HEAD_HASH_CODE"))
    )


def all_data(fm: DataFrame, with_commit: bool = False) -> DataFrame:
    """Every revision with its path's head and its content's origin.

    The origin of a hash is its first revision by COMMIT_TIME, then owner, repository, path and commit. IS_UNIQUE is true
    for a hash with one revision, else null. For a deletion the O_ columns and IS_UNIQUE are null. An empty input gives an
    empty result; columns beside the six of FILE_METADATA are ignored. ``with_commit`` keeps COMMIT_ID, by which folder states
    order the revisions of a path at one time."""
    rows = with_head(fm.select(*BASE, "COMMIT_ID"))
    first = F.struct("COMMIT_TIME", *PATH, "COMMIT_ID", "HEAD_HASH_CODE", "HEAD_COMMIT_TIME")
    alive = rows.filter(F.col("HASH_CODE").isNotNull())
    origins = alive.groupBy("HASH_CODE").agg(F.min(first).alias("_o"), F.count("*").alias("_n")).select(
        "HASH_CODE",
        *[F.col(f"_o.{c}").alias(f"O_{c}") for c in (*PATH, "COMMIT_TIME", "HEAD_HASH_CODE", "HEAD_COMMIT_TIME")],
        F.when(F.col("_n") == 1, F.lit(True)).alias("IS_UNIQUE"),
    )
    kept = [*BASE, "COMMIT_ID"] if with_commit else [*BASE]
    out = [*kept, *HEAD, *ORIGIN, "IS_UNIQUE"]
    deleted = rows.filter(F.col("HASH_CODE").isNull()).select(
        *kept, *HEAD, *[F.lit(None).cast("long" if c.endswith("TIME") else "string").alias(c) for c in ORIGIN], F.lit(None).cast("boolean").alias("IS_UNIQUE")
    )
    return alive.join(origins, "HASH_CODE").select(*out).unionByName(deleted)


def orig(data: DataFrame) -> DataFrame:
    """The distinct origins of contents."""
    return (
        data.filter(F.col("HASH_CODE").isNotNull() & (F.col("COMMIT_TIME") == F.col("O_COMMIT_TIME")))
        .select("O_REPO_OWNER", "O_REPOSITORY", "O_GIT_PATH", "O_COMMIT_TIME", "HASH_CODE", "O_HEAD_COMMIT_TIME", "O_HEAD_HASH_CODE", "IS_UNIQUE")
        .distinct()
    )


def copy(data: DataFrame) -> DataFrame:
    """Revisions that repeat a content of another path, later than its origin, and are not a move of it (the origin's path
    deleted for good at the very time of the revision)."""
    c = F.col
    elsewhere = (c("REPO_OWNER") != c("O_REPO_OWNER")) | (c("REPOSITORY") != c("O_REPOSITORY")) | (c("GIT_PATH") != c("O_GIT_PATH"))
    moved = c("O_HEAD_HASH_CODE").isNull() & (c("O_HEAD_COMMIT_TIME") == c("COMMIT_TIME"))
    return data.filter(c("HASH_CODE").isNotNull() & (c("COMMIT_TIME") != c("O_COMMIT_TIME")) & elsewhere & ~moved).select(*BASE, *HEAD, *ORIGIN)


def head_copy(data: DataFrame) -> DataFrame:
    """Copies that still are the head of their path."""
    return copy(data).filter(F.col("COMMIT_TIME") == F.col("HEAD_COMMIT_TIME"))
