"""Named queries over a directory of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id
from siltstone.operators import checkpoint as C
from siltstone.operators import counts, explore, fingerprint, history, imports, npm, orphans, skew, versions
from siltstone.session import materialise, scratch
from siltstone.sources.lake import file_metadata, read_lake, table

Query = Callable[[SparkSession, str], DataFrame]


def _fresh(s: SparkSession, d: str) -> DataFrame:
    return history.all_data(file_metadata(s, d))


def _data(s: SparkSession, d: str) -> DataFrame:
    """The enriched revisions, which all queries share: written once for each version of the inputs."""
    return C.sticky_checkpoint(history.all_data(file_metadata(s, d), with_commit=True), "all_data")


def _examples(s: SparkSession, d: str) -> DataFrame:
    data = _data(s, d)
    return C.sticky_checkpoint(lambda: imports.copy_as_import_examples(data, imports.RANKS), "copy_as_import_examples", source=data, parameters={"ranks": imports.RANKS})


def _on_data(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(_data(s, d))


def _on_examples(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(_examples(s, d))


def _unidentified(only_matched: bool) -> Query:
    return lambda s, d: imports.unidentified_node_copies(_data(s, d), _examples(s, d), only_matched)


def _lake(s: SparkSession, d: str) -> DataFrame:
    """The table in a lake of three crawls, of which the last repeats the others, read as one."""
    base = scratch(s, "lake")
    rows = table(s, d, "file_metadata").select(
        "row_id", F.col("repo_owner").alias("REPO_OWNER"), F.col("repository").alias("REPOSITORY"), F.col("git_path").alias("GIT_PATH"), hex_id("hash_code").alias("HASH_CODE"), F.col("commit_time").alias("COMMIT_TIME"), hex_id("commit_id").alias("COMMIT_ID")
    )
    for crawl, part in (("even", rows.filter("row_id % 2 = 0")), ("odd", rows.filter("row_id % 2 <> 0")), ("again", rows)):
        part.drop("row_id").write.parquet(f"{base}/data/{crawl}/FILE_METADATA")
    return read_lake(s, base, "FILE_METADATA")


def _answers(s: SparkSession, d: str) -> DataFrame:
    """The table's repositories serve as the registry: each answers for the package of its name."""
    answers = table(s, d, "file_metadata").groupBy("repository").agg(F.min("repo_owner").alias("o"))
    url = F.concat(F.lit('"url":"git://github.com/'), "o", F.lit("/"), "repository", F.lit('.git"'))
    return answers.select(F.col("repository").alias("PACKAGE"), url.alias("RESPONSE"))


def _names(s: SparkSession, d: str) -> DataFrame:
    return npm.essential_node_packages(history.orig(_data(s, d)))


def _git_repos_of_file(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "names")
    _names(s, d).filter("trim(REPO) <> ''").select("REPO").write.text(path)
    return npm.essential_node_git_repos_of(s, path, _answers(s, d))


def _semi(data: DataFrame) -> DataFrame:
    heads = history.head_copy(data).select(F.col("O_REPO_OWNER").alias("REPO_OWNER"), F.col("O_REPOSITORY").alias("REPOSITORY"))
    return C.semi_filter(data, heads, ["REPO_OWNER", "REPOSITORY"]).agg(F.count("*").alias("n"))


def _bloom(data: DataFrame) -> DataFrame:
    """Hashes of copies as a filter, asked about all hashes: how many belong to it, how many of these it misses, and whether it lets
    through at most twice the rate of others that it is made for."""
    fpr = 0.001
    members = history.copy(data).select("HASH_CODE").distinct()
    shape = C.bloom_shape(members.count(), fpr)
    passed = C.might_contain(data, "HASH_CODE", C.bloom_words(members, "HASH_CODE", *shape), *shape).select(F.col("value").alias("HASH_CODE"), F.lit(1).alias("passed"))
    asked = data.filter("HASH_CODE IS NOT NULL").select("HASH_CODE").distinct()
    told = asked.join(members.withColumn("member", F.lit(1)), "HASH_CODE", "left").join(passed, "HASH_CODE", "left")
    others, wrong = F.count_if(F.expr("member IS NULL")), F.count_if(F.expr("member IS NULL AND passed = 1"))
    return told.agg(F.count("member").alias("n_members"), F.count_if(F.expr("member = 1 AND passed IS NULL")).alias("n_missed"), (wrong <= 2 * fpr * others + 5).alias("within_rate"))


def _summaries(data: DataFrame) -> DataFrame:
    found = explore.summaries({"all_data": data.drop("COMMIT_ID"), "orig": history.orig(data), "copy": history.copy(data)})
    return found.withColumns({c: F.round(c, 1) for c in ("mean", "stddev")})


def _phases(data: DataFrame) -> DataFrame:
    return explore.copy_phase(data).withColumns({c: F.round(c, 6) for c in ("mean_phase", "sum_phase")})


def _orphans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fm = table(s, d, "file_metadata")
    state = orphans.reference_state(fm, table(s, d, "commit_messages"), table(s, d, "contents"))
    return orphans.references(fm), materialise(state, "references")


def _keys(s: SparkSession, d: str) -> DataFrame:
    return skew.per_key(skew.revision_keys(table(s, d, "file_metadata")))


QUERIES: dict[str, Query] = {
    "q00_lake_read": _lake,
    "q01_all_data": _fresh,
    "q02_orig": _on_data(history.orig),
    "q03_copy": _on_data(history.copy),
    "q04_head_copy": _on_data(history.head_copy),
    "q05_all_paths_count": _on_data(counts.all_paths_count),
    "q06_orig_paths_count": _on_data(counts.orig_paths_count),
    "q07_copy_paths_count": _on_data(counts.copy_paths_count),
    "q08_divergent_copy_count": _on_data(counts.divergent_copy_count),
    "q09_active_repo_obsolete_copy_count": _on_data(counts.active_repo_obsolete_copy_count),
    "q10_ranked_orig_folder_hash": lambda s, d: fingerprint.ranked_orig_folder_hash(_data(s, d)).drop("sum_hash_crc", "sum_name_crc"),
    "q11_copy_folder_hash": lambda s, d: fingerprint.copy_folder_hash(_data(s, d)).drop("sum_hash_crc", "sum_name_crc"),
    "q12_copy_as_import_examples": lambda s, d: _examples(s, d).drop("sum_hash_crc", "sum_name_crc"),
    "q13_copy_as_import_count": _on_examples(imports.copy_as_import_count),
    "q14_popular_other_folders": _on_examples(lambda e: imports.popular_other_folders(e, 5)),
    "q15_unidentified_node_copies": _unidentified(True),
    "q15b_unidentified_node_copies_literal": _unidentified(False),
    "q16_essential_node_packages": _names,
    "q17_essential_node_git_repos": lambda s, d: npm.essential_node_git_repos(_names(s, d), _answers(s, d)),
    "q17b_essential_node_git_repos_of_file": _git_repos_of_file,
    "q18_approx_sizes": _on_data(lambda a: C.approx_sizes(a, ["REPO_OWNER", "REPOSITORY", "HASH_CODE"])),
    "q18b_semi_filter": _on_data(_semi),
    "q18c_bloom_filter": _on_data(_bloom),
    "q19_summary": _on_data(_summaries),
    "q20_true_path_copy": _on_data(explore.true_path_copy),
    "q21_copy_chain": _on_data(explore.copy_chain),
    "q21b_copy_chain_hubs": _on_data(explore.copy_chain_hubs),
    "q22_copy_phase": _on_data(_phases),
    "q23_test_phase": _on_data(explore.test_phase),
    "p3_found": lambda s, d: versions.path_versions(table(s, d, "file_metadata")),
    "p6_found": lambda s, d: skew.heavy_keys(_keys(s, d)).select("field_name", "key_value"),
    "p6_keys": _keys,
    "p7_found": lambda s, d: orphans.orphan_rows(*_orphans(s, d)).select("target_table", "row_id"),
    "p7_report": lambda s, d: orphans.orphan_report(*_orphans(s, d)),
}
