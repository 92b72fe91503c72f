"""Reading the lake: crawl directories with declared schemas, or one Parquet table per file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id
from siltstone.schemas import SPLITS


def deduplicate(df: DataFrame, split: str) -> DataFrame:
    """One row per uniqueness key. Of the columns outside the key the least value holds (null only if all are null),
    so that the result does not depend on the order of the rows. Other columns are dropped."""
    s = SPLITS[split]
    rest = [c for c in s.columns if c not in s.key]
    if not rest:
        return df.select(*s.key).distinct()
    if len(rest) == 1:
        least = [F.min(rest[0]).alias(rest[0])]
    else:  # one row's values stay together
        row = F.min(F.struct(*rest)).alias("_row")
        return df.groupBy(*s.key).agg(row).select(*s.key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*s.columns)
    return df.groupBy(*s.key).agg(*least).select(*s.columns)


def read_lake(spark: SparkSession, base: str, split: str) -> DataFrame:
    """``<base>/data/<crawl>/<split>/`` of all crawls, with the declared schema, without duplicates."""
    s = SPLITS[split]
    return deduplicate(spark.read.schema(s.schema).parquet(f"{base.rstrip('/')}/data/*/{split}/"), split)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``<sf_dir>/<name>.parquet`` as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILE_METADATA of the flat layout: identifiers in normal form, blank hashes null, without duplicates."""
    t = table(spark, sf_dir, "file_metadata").select(
        F.col("repo_owner").alias("REPO_OWNER"),
        F.col("repository").alias("REPOSITORY"),
        F.col("git_path").alias("GIT_PATH"),
        hex_id("hash_code").alias("HASH_CODE"),
        F.col("commit_time").alias("COMMIT_TIME"),
        hex_id("commit_id").alias("COMMIT_ID"),
    )
    return deduplicate(t, "FILE_METADATA")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file in the column ``value``."""
    return spark.read.text(path)


def write_text(df: DataFrame, path: str) -> None:
    """All columns joined by commas, one file. Only for small reports: it is written by one task."""
    df.select(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def read_properties(path: str) -> dict[str, str]:
    """``key=value`` or ``key: value`` lines; ``#`` and ``!`` start comments. A missing file raises."""
    out = {}
    for line in Path(path).read_text().splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            at = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=len(line))
            out[line[:at].strip()] = line[at + 1 :].strip()
    return out


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and time of every file below a directory; names that start with a dot or underscore are skipped."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    )


def delete_recursively(path: str) -> None:
    """Remove a local directory; failures are ignored."""
    import shutil

    shutil.rmtree(path, ignore_errors=True)
