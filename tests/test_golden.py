"""Counts worked out beforehand on a synthetic history made of the events table."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import counts, history, imports
from siltstone.sources.lake import deduplicate

PREFIXES = ("node_modules/", "bower_components/", "www/", ".bower-cache/", "lib/node_modules/")


def synthetic(spark, sf):
    whens = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PREFIXES))
    df = spark.read.parquet(f"/root/testdata/{sf}/events.parquet").selectExpr(
        "'u' || (user_id % 60) AS REPO_OWNER",
        "event_type AS REPOSITORY",
        f"CASE event_id % 7 {whens} ELSE 'src/' END || 'p' || (user_id % 3) || CASE WHEN user_id % 2 = 0 THEN '/node_modules/q' ELSE '' END || '/f' || (event_id % 3) || '.js' AS GIT_PATH",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE 'h' || (CAST(floor(value) AS BIGINT) % 40) END AS HASH_CODE",
        "CAST(floor(event_id / 200) AS BIGINT) AS COMMIT_TIME",
        "'c' || event_id AS COMMIT_ID",
    )
    return history.all_data(deduplicate(df, "FILE_METADATA"), with_commit=True)


GOLDEN = {
    "sf0.001": (1000, 221, 181, 570, 451, 624, {None: 24, True: 131}, {True: 16}, {False: 60, True: 109}, (131, 268, 1, 0)),
    "sf0.01": (10000, 1858, 1818, 7107, 3252, 4003, {None: 5, True: 791}, {True: 420}, {False: 311, True: 2137}, (135, 3017, 10, 0)),
}


@pytest.mark.parametrize("sf", sorted(GOLDEN))
def test_counts(spark, sf):
    n, orig, unique, copy, head, paths, origs, divergent, obsolete, bands = GOLDEN[sf]
    d = synthetic(spark, sf).persist()
    pairs = lambda df: {r[0]: r[1] for r in df.collect()}
    assert d.count() == n
    o = history.orig(d)
    assert (o.count(), o.filter("IS_UNIQUE").count()) == (orig, unique)
    assert (history.copy(d).count(), history.head_copy(d).count()) == (copy, head)
    assert counts.all_paths_count(d).first()[0] == paths
    assert pairs(counts.orig_paths_count(d)) == origs
    assert pairs(counts.divergent_copy_count(d)) == divergent
    assert pairs(counts.active_repo_obsolete_copy_count(d)) == obsolete
    e = imports.copy_as_import_examples(d).persist()
    r = F.col("ROW_NUM")
    assert (e.filter(r.isNull()).count(), e.filter(r == 1).count(), e.filter(r.between(2, 10)).count(), e.filter(r > 10).count()) == bands
    d.unpersist()
    if sf == "sf0.01":
        got = {(x[0], x[1]): x[2] for x in imports.copy_as_import_count(e).collect()}
        names = ("BOWER", "NPM", "OTHERS", "WWW")
        assert got == {(False, n): v for n, v in zip(names, (29, 123, 25, 37))} | {(True, n): v for n, v in zip(names, (271, 954, 145, 268))}
    e.unpersist()
