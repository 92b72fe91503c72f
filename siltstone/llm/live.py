"""Revisions and live contents, as problems 2, 4 and 5 read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id
from siltstone.functions.paths import extension

REVISION = ("repo_owner", "repository", "git_path", "hash_code")


def revisions(file_metadata: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct (repo_owner, repository, git_path, hash_code) with a hash, and the path's extension; with ``extensions``
    only those of one."""
    rows = file_metadata.select("repo_owner", "repository", "git_path", hex_id("hash_code").alias("hash_code")).filter(F.col("hash_code").isNotNull())
    rows = rows.withColumn("extension", extension(F.col("git_path")))
    if extensions:
        rows = rows.filter(F.col("extension").isin(*extensions))
    return rows.distinct()


def live_contents(contents: DataFrame) -> DataFrame:
    """hash_code, text of each content with a row that is not withdrawn. A null text of such a row counts as empty; of
    different texts under one hash, which a sound table has not, the greatest holds."""
    rows = contents.filter(F.col("deleted_at").isNull()).select(hex_id("hash_code").alias("hash_code"), F.coalesce("contents", F.lit("")).alias("text"))
    return rows.filter(F.col("hash_code").isNotNull()).groupBy("hash_code").agg(F.max("text").alias("text"))
