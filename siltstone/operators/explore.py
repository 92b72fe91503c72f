"""Exploratory views: summaries, copies of a whole path, chains of copies, and when copies and tests come."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import history as H

REPO = ("REPO_OWNER", "REPOSITORY")


def summary(df: DataFrame) -> DataFrame:
    """As one row per column: rows of the frame, non-null values, and of these the mean and standard deviation (of a sample; null for
    columns that are not numbers, and the latter for a single value), the least and the greatest. One pass over the input."""
    kinds = dict(df.dtypes)
    aggs = [F.count("*").alias("_all")]
    number = lambda c: kinds[c] not in ("string", "boolean")
    for c in df.columns:
        v = F.col(c).cast("string") if kinds[c] == "boolean" else F.col(c)
        aggs += [F.count(c).alias(f"{c}|n"), F.min(v).cast("string").alias(f"{c}|min"), F.max(v).cast("string").alias(f"{c}|max")]
        if number(c):
            aggs += [F.avg(c).alias(f"{c}|mean"), F.stddev(c).alias(f"{c}|sd")]
    one = df.agg(*aggs)
    none = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("_all").alias("n_rows"), F.col(f"{c}|n").alias("n_values"), (F.col(f"{c}|mean") if number(c) else none).alias("mean"),
            (F.col(f"{c}|sd") if number(c) else none).alias("stddev"), F.col(f"{c}|min").alias("least"), F.col(f"{c}|max").alias("greatest"),
        )
        for c in df.columns
    ]
    return one.select(F.inline(F.array(*rows)))


def summaries(frames: dict[str, DataFrame]) -> DataFrame:
    """``summary`` of several frames, by their names in ``frame``."""
    each = [summary(df).select(F.lit(name).alias("frame"), "*") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, each)


def true_path_copy(data: DataFrame) -> DataFrame:
    """Head copies in another repository whose path is the origin's with more text: the text before the origin's length,
    and the latest origin time for each such prefix."""
    c = F.col
    prefix = F.substring(c("GIT_PATH"), F.lit(1), F.length("GIT_PATH") - F.length("O_GIT_PATH"))
    return (
        H.head_copy(data)
        .filter((c("REPO_OWNER") != c("O_REPO_OWNER")) | (c("REPOSITORY") != c("O_REPOSITORY")))
        .filter((F.length("GIT_PATH") > F.length("O_GIT_PATH")) & c("GIT_PATH").contains(c("O_GIT_PATH")))
        .withColumn("GIT_PATH_PREFIX", prefix)
        .groupBy(*REPO, "COMMIT_TIME", "GIT_PATH_PREFIX", "O_REPO_OWNER", "O_REPOSITORY")
        .agg(F.max("O_COMMIT_TIME").alias("O_COMMIT_TIME"))
    )


def copy_chain(data: DataFrame) -> DataFrame:
    """Links of repositories: a copier (C) of an origin (O) that itself is the copier of another (OO). Distinct pairs are
    linked, with the number of copies on either side, so that a repository with many copies gives no product of rows."""
    pair = lambda a, b, n: H.copy(data).groupBy(F.concat_ws("/", "O_REPO_OWNER", "O_REPOSITORY").alias(a), F.concat_ws("/", *REPO).alias(b)).agg(F.count("*").alias(n))
    return pair("O", "C", "n_copies").join(pair("OO", "O", "n_origin_copies"), "O").select("OO", "O", "C", "n_copies", "n_origin_copies")


def copy_chain_hubs(data: DataFrame) -> DataFrame:
    """The middle repositories of the chains, one row each: how many repositories they copied from and were copied to, and the number
    of copies on either side. No product of the two sides is formed."""
    name = lambda a, b: F.concat_ws("/", a, b)
    side = H.copy(data).select(
        F.inline(
            F.array(
                F.struct(name("O_REPO_OWNER", "O_REPOSITORY").alias("O"), name(*REPO).alias("_to"), F.lit(None).cast("string").alias("_from")),
                F.struct(name(*REPO).alias("O"), F.lit(None).cast("string").alias("_to"), name("O_REPO_OWNER", "O_REPOSITORY").alias("_from")),
            )
        )
    )
    # counted per pair first, so that a repository of any number of copies gives few rows
    pairs = side.groupBy("O", "_to", "_from").agg(F.count("*").alias("_n"))
    hubs = pairs.groupBy("O").agg(
        F.count("_from").alias("n_origins"), F.count("_to").alias("n_copiers"), F.coalesce(F.sum(F.when(F.col("_from").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_copied"), F.coalesce(F.sum(F.when(F.col("_to").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_copies")
    )
    return hubs.filter("n_origins > 0 AND n_copiers > 0")


def copy_phase(data: DataFrame) -> DataFrame:
    """When in a repository's life its first copy comes (0 first commit, 1 last; the span counts one second more): mean, sum
    and count by the numbers of its commit times and paths."""
    repo = data.groupBy(*REPO).agg(F.min("COMMIT_TIME").alias("_first"), F.max("COMMIT_TIME").alias("_last"), F.countDistinct("COMMIT_TIME").alias("n_commits"), F.countDistinct("GIT_PATH").alias("n_paths"))
    first = H.copy(data).groupBy(*REPO).agg(F.min("COMMIT_TIME").alias("_copy"))
    c = F.col
    phase = (c("_copy") - c("_first")) / (c("_last") - c("_first") + 1)
    return repo.join(first, list(REPO)).groupBy("n_commits", "n_paths").agg(F.avg(phase).alias("mean_phase"), F.sum(phase).alias("sum_phase"), F.count("*").alias("n_repos"))


def test_phase(data: DataFrame) -> DataFrame:
    """For each repository, when the first commit touches a path with 'test/' in it; its last commit where none does."""
    t = F.min(F.when(F.lower("GIT_PATH").contains("test/"), F.col("COMMIT_TIME")))
    return data.groupBy(*REPO).agg(F.coalesce(t, F.max("COMMIT_TIME")).alias("T_COMMIT_TIME"))
