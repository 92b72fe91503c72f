"""Small tables in short form, and comparison with an independent engine."""

from __future__ import annotations

import duckdb

FM = "REPO_OWNER string, REPOSITORY string, GIT_PATH string, HASH_CODE string, COMMIT_TIME long, COMMIT_ID string"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings file_metadata commit_messages contents hash_index".split()


def revisions(spark, *rows):
    """Rows 'owner/repo path hash time' (hash - for a deletion), commits numbered in order."""
    out = []
    for i, r in enumerate(rows):
        repo, path, h, t = r.split(" ")
        owner, name = repo.split("/")
        out.append((owner, name, path, None if h == "-" else h, int(t), f"c{i:03}"))
    return spark.createDataFrame(out, FM)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def same_as_sql(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df, *names) == sorted(map(tuple, got.fetchall()), key=repr)
