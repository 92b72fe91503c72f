"""Names of packages carried in paths, and the repositories a registry gives for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.paths import nested_packages
from siltstone.sources.lake import read_text

RETRIES, TIMEOUT = 3, 2.0

# Fixed value: where a registry's answer names a repository, and what ends the name.
REPOSITORY_URL = r'git://github\.com/([^/]+)/(.+?)(\.git|")'


def essential_node_packages(origins: DataFrame) -> DataFrame:
    """Distinct names after any 'node_modules/' of the origins' paths."""
    return origins.select(F.explode(nested_packages(F.col("O_GIT_PATH"))).alias("REPO")).distinct()


def essential_node_git_repos(packages: DataFrame, responses: DataFrame) -> DataFrame:
    """Owner and repository for each row of ``packages`` (REPO) by the registry's answers (PACKAGE, RESPONSE).

    A name without an answer is tried once more up to its first dot. Rows without an answer, or whose answer names no
    repository, are left out; equal results stay. The registry is looked up by a join, so no task waits for a network.
    ``fetch_responses`` fills the table of answers where there is one."""
    r = responses.groupBy("PACKAGE").agg(F.min("RESPONSE").alias("RESPONSE"))
    short = F.split(F.col("p.REPO"), "\\.")[0]
    found = (
        packages.alias("p")
        .join(r.alias("full"), F.col("p.REPO") == F.col("full.PACKAGE"), "left")
        .join(r.alias("part"), F.col("full.PACKAGE").isNull() & (short == F.col("part.PACKAGE")), "left")
        .select(F.coalesce("full.RESPONSE", "part.RESPONSE").alias("r"))
    )
    return (
        found.select(F.regexp_extract("r", REPOSITORY_URL, 1).alias("REPO_OWNER"), F.regexp_extract("r", REPOSITORY_URL, 2).alias("REPOSITORY"))
        .filter((F.col("REPO_OWNER") != "") & (F.col("REPOSITORY") != ""))
    )


def essential_node_git_repos_of(spark: SparkSession, path: str, responses: DataFrame) -> DataFrame:
    """The same for a text file of names, one a line. Lines count as they are, blank ones not at all."""
    names = read_text(spark, path).select(F.trim("value").alias("REPO")).filter("REPO <> ''")
    return essential_node_git_repos(names, responses)


def fetch_responses(packages: DataFrame, fetch: Callable[[str], str | None], retries: int = RETRIES) -> DataFrame:
    """PACKAGE, RESPONSE, ERROR by calling ``fetch(name)`` for each distinct REPO on the executors, in Arrow batches. A call that raises
    is made up to ``retries`` more times; if it still raises, RESPONSE is null and ERROR says why, so that an outage is not taken
    for a missing package. A package for which nothing is given (None) has null in both. Null and blank names are left out."""

    def one(name: str) -> tuple[str | None, str | None]:
        for left in range(retries, -1, -1):
            try:
                return fetch(name), None
            except Exception as e:
                if not left:
                    return None, f"{type(e).__name__}: {e}"
        return None, None

    def run(batches):
        for b in batches:
            out = b.rename(columns={"REPO": "PACKAGE"})
            answers = [one(n) for n in out["PACKAGE"]]
            out["RESPONSE"], out["ERROR"] = [a for a, _ in answers], [e for _, e in answers]
            yield out

    return packages.select("REPO").filter(F.trim("REPO") != "").distinct().mapInPandas(run, "PACKAGE string, RESPONSE string, ERROR string")


def http_fetch(base: str, timeout: float = TIMEOUT) -> Callable[[str], str | None]:
    """A fetcher of ``<base>/<name>`` over HTTP: None for a package the registry does not know, an exception for any other failure, a
    connection that takes more than ``timeout`` seconds included."""

    def fetch(name: str) -> str | None:
        from urllib.error import HTTPError
        from urllib.parse import quote
        from urllib.request import urlopen

        try:
            with urlopen(f"{base.rstrip('/')}/{quote(name, safe='@')}", timeout=timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except HTTPError as e:
            if e.code == 404:
                return None
            raise

    return fetch
