"""Heads, origins, copies, counts, folders and imports on hand-written histories."""

import pytest
from helpers import revisions, rows
from pyspark.sql import functions as F

from siltstone.operators import counts, explore, fingerprint, history, imports, npm


def data(spark, *r):
    return history.all_data(revisions(spark, *r))


def test_two_origins_in_one_commit(spark):
    d = data(spark, "o/r a h1 1", "o/r b h1 1")
    assert history.orig(d).count() == 1 and history.copy(d).count() == 0


def test_revert_is_no_copy(spark):
    d = data(spark, "o/r a h1 1", "o/r a h2 2", "o/r a h1 3")
    assert history.copy(d).count() == 0
    assert rows(history.orig(d), "HASH_CODE", "IS_UNIQUE") == [("h1", None), ("h2", True)]


def test_moves(spark):
    at_once = data(spark, "o/r a h1 1", "o/r a - 2", "o/r b h1 2")
    late = data(spark, "o/r a h1 1", "o/r b h1 2", "o/r a - 3")
    assert history.copy(at_once).count() == 0 and history.copy(late).count() == 1


def test_copy_across_repositories_and_divergence(spark):
    d = data(spark, "o/r a h1 1", "p/s b h1 2")
    assert rows(history.head_copy(d), "REPO_OWNER", "O_REPO_OWNER") == [("p", "o")]
    d = data(spark, "o/r a h1 1", "p/s b h1 2", "p/s b h2 3")
    assert history.head_copy(d).count() == 0
    assert rows(counts.divergent_copy_count(d)) == [(True, 1)]


def test_obsolete_copies(spark):
    d = data(spark, "o/r a h1 1", "p/s b h1 2", "q/t c h1 2", "o/r a h2 5", "p/s d h3 9")
    assert rows(counts.active_repo_obsolete_copy_count(d)) == [(False, 1), (True, 1)]
    gone = data(spark, "o/r a h1 1", "p/s b h1 2", "o/r a - 5")
    assert counts.active_repo_obsolete_copy_count(gone).count() == 0


def test_deletions_have_no_origin(spark):
    d = data(spark, "o/r a h1 1", "o/r a - 2").filter("HASH_CODE IS NULL")
    assert rows(d, "HEAD_COMMIT_TIME", "O_REPO_OWNER", "IS_UNIQUE") == [(2, None, None)]


def test_nulls_repeats_clashes_and_no_rows(spark):
    r = revisions(spark, "o/r a h1 1", "o/r a h1 1").withColumn("IS_UNIQUE", F.lit("x")).withColumn("_h", F.lit(1))
    d = history.all_data(r.withColumn("REPO_OWNER", F.lit(None).cast("string")))
    assert rows(d, "REPO_OWNER", "HEAD_HASH_CODE", "IS_UNIQUE") == [(None, "h1", None)] * 2
    assert history.all_data(r.limit(0)).count() == 0
    assert counts.all_paths_count(history.all_data(r.limit(0))).first()[0] == 0


def states(spark, *r):
    """Number of files of each state of a repository's folders, in order of time."""
    d = data(spark, *r)
    deltas = fingerprint.folder_deltas(d)
    return [tuple(x) for x in deltas.orderBy("COMMIT_TIME", "FOLDER").select("FOLDER", "_df").collect()]


def test_folder_deltas(spark):
    assert states(spark, "o/r d/a h1 1", "o/r d/a - 2", "o/r d/a - 3", "o/r d/a h2 4") == [("d", 1), ("d", -1), ("d", 0), ("d", 1)]


FOLDER = ["o/r lib/a h1 1", "o/r lib/b h2 1", "o/r lib/c h3 1"]
IMPORTED = ["p/s node_modules/x/a h1 2", "p/s node_modules/x/b h2 2", "p/s node_modules/x/c h3 2"]
HOME = ["o/s z hz 1", "p/r y hy 1"]


def test_folder_import(spark):
    d = data(spark, *FOLDER, *IMPORTED)
    e = imports.copy_as_import_examples(d)
    assert rows(e, "FOLDER", "n_files", "O_REPO_OWNER", "O_FOLDER", "ROW_NUM") == [("node_modules/x", 3, "o", "lib", 1)]
    assert rows(imports.copy_as_import_count(e)) == [(True, "NPM", 3)]


def test_folder_within_the_repository_is_no_import(spark):
    d = data(spark, *FOLDER, *[r.replace("p/s", "o/r") for r in IMPORTED])
    assert rows(imports.copy_as_import_examples(d), "O_REPO_OWNER") == [(None,)]


def frame(spark, kind, rows_):
    return spark.createDataFrame(rows_, kind)


ORIGINS = "O_REPO_OWNER string, O_REPOSITORY string, O_COMMIT_TIME long, O_FOLDER string, sum_hash_crc long, sum_name_crc long, n_files long, ROW_NUM int"
COPIES = "REPO_OWNER string, REPOSITORY string, COMMIT_TIME long, FOLDER string, sum_hash_crc long, sum_name_crc long, n_files long"


def three_passes(copies, origins):
    """The ranked match in bands of ranks, each over what the former left: the form the one pass replaces."""
    out = {}
    for c in copies:
        for lo, hi in ((1, 1), (2, 10), (11, 100)):
            hits = [o for o in origins if o[4:7] == c[4:7] and lo <= o[7] <= hi and c[2] > o[2] and (c[0], c[1]) != (o[0], o[1])]
            if hits:
                out[c[:4]] = (lo, hi)
                break
    return out


def test_ranks(spark):
    copies = [("p", "s", 500, "x", 1, 1, 1), ("p", "s", 500, "y", 2, 2, 1), ("p", "s", 500, "z", 3, 3, 1)]
    origins = [("p", "s", i, f"f{i}", 1, 1, 1, i) for i in range(1, 13)] + [("o", "r", 13, "g", 1, 1, 1, 13)]
    origins += [("p", "s", i, f"f{i}", 2, 2, 1, i) for i in range(1, 101)] + [("o", "r", 101, "g", 2, 2, 1, 101)]
    origins += [("o", "r", 500, "g", 3, 3, 1, 1)]
    got = imports.match_imports(frame(spark, COPIES, copies), frame(spark, ORIGINS, origins))
    ranks = {(r.REPO_OWNER, r.REPOSITORY, r.COMMIT_TIME, r.FOLDER): r.ROW_NUM for r in got.collect()}
    assert sorted(ranks.values(), key=repr) == [13, None, None]
    bands = three_passes(copies, origins)
    assert {k for k, v in ranks.items() if v} == set(bands) and all(bands[k][0] <= v <= bands[k][1] for k, v in ranks.items() if v)


def test_candidates_are_tested_by_column(spark):
    d = data(spark, "o/r a h1 1", "q/t a h2 1", "x/y b h1 2", "x/y c h2 2", "o/t e h3 1", "o/z e h4 1")
    assert ("o", "t") in rows(fingerprint.candidates(d), "REPO_OWNER", "REPOSITORY") and ("o", "z") not in rows(fingerprint.candidates(d), "REPO_OWNER", "REPOSITORY")


def test_labels_differ_by_query(spark):
    e = frame(spark, "REPO_OWNER string, REPOSITORY string, FOLDER string, n_files long, O_REPO_OWNER string", [("o", "r", "www/node_modules/a", 2, "p"), ("o", "r", "bower/b", 1, None), ("o", "r", "x/node_modules", 1, None)])
    assert rows(imports.copy_as_import_count(e)) == [(False, "OTHERS", 2), (True, "WWW", 2)]
    assert rows(imports.popular_other_folders(e, 0)) == [("node_modules", 1), ("x", 1)]


@pytest.mark.parametrize("only_matched, expected", [(True, [("p", "s", "a/node_modules/m.js")]), (False, [])])
def test_unidentified(spark, only_matched, expected):
    d = data(spark, "o/r k.js h1 1", "o/r l.js h0 1", "p/s a/node_modules/m.js h1 2")
    e = imports.copy_as_import_examples(d)
    assert rows(imports.unidentified_node_copies(d, e, only_matched)) == expected


def test_packages(spark):
    paths = ["node_modules/a/node_modules/b/i.js", "node_modules/node_modules/x", "node_modules/@s/p/q"]
    o = spark.createDataFrame([(p,) for p in paths], "O_GIT_PATH string")
    assert rows(npm.essential_node_packages(o)) == [("@s",), ("a",), ("b",), ("node_modules",), ("x",)]


def test_registry(spark):
    p = spark.createDataFrame([("a",), ("b.js",), ("c",), ("none",)], "REPO string")
    r = spark.createDataFrame([("a", '"git://github.com/o/a.git"'), ("b", '{"u":"git://github.com/p/b"}'), ("c", "nothing")], "PACKAGE string, RESPONSE string")
    assert rows(npm.essential_node_git_repos(p, r)) == [("o", "a"), ("p", "b")]


def test_registry_of_a_file(spark, tmp_path):
    (tmp_path / "names.txt").write_text("a\n b.js \n\nnone\n")
    r = spark.createDataFrame([("a", '"git://github.com/o/a.git"'), ("b", '"git://github.com/p/b.git"')], "PACKAGE string, RESPONSE string")
    assert rows(npm.essential_node_git_repos_of(spark, f"{tmp_path}/names.txt", r)) == [("o", "a"), ("p", "b")]


def test_fetching_tells_outages_from_missing_packages(spark, tmp_path):
    p = spark.createDataFrame([("a",), ("a",), ("flaky",), ("none",), ("down",), (None,), (" ",)], "REPO string")

    def fetch(name):
        if name == "flaky":
            with open(f"{tmp_path}/calls", "a+") as f:
                f.write("x")
                f.seek(0)
                if len(f.read()) < 4:
                    raise TimeoutError("slow")
        if name == "down":
            raise ConnectionError("refused")
        return None if name == "none" else name.upper()

    got = {r.PACKAGE: (r.RESPONSE, r.ERROR) for r in npm.fetch_responses(p, fetch).collect()}
    assert got == {"a": ("A", None), "flaky": ("FLAKY", None), "none": (None, None), "down": (None, "ConnectionError: refused")}


def test_http_fetch():
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(1)
            code = {"/a": 200, "/none": 404}.get(self.path, 500)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"git")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    fetch = npm.http_fetch(f"http://127.0.0.1:{server.server_port}/", timeout=0.3)
    assert fetch("a") == "git" and fetch("none") is None
    for name in ("broken", "slow"):
        with pytest.raises(OSError):
            fetch(name)
    server.shutdown()


def test_true_path_copies(spark):
    d = data(
        spark, "o/r lib/a.js h1 1", "o/r b.js h2 1", "o/r long/name.js h3 1",
        "p/s vendor/lib/a.js h1 2", "p/s vendor/lib/a2.js h1 2", "p/s third/b.js h2 2", "p/s x.js h3 2", "o/r old/b.js h2 3", "q/t vendor/lib/a.js h1 5", "q/t vendor/lib/a.js - 6",
    )
    # in another repository, at the head, with the origin's path within a longer one
    want = set()
    for r in history.head_copy(d).collect():
        if (r.REPO_OWNER, r.REPOSITORY) != (r.O_REPO_OWNER, r.O_REPOSITORY) and r.O_GIT_PATH in r.GIT_PATH and len(r.GIT_PATH) > len(r.O_GIT_PATH):
            want.add((r.REPO_OWNER, r.REPOSITORY, r.COMMIT_TIME, r.GIT_PATH[: len(r.GIT_PATH) - len(r.O_GIT_PATH)], r.O_REPO_OWNER, r.O_REPOSITORY, r.O_COMMIT_TIME))
    got = rows(explore.true_path_copy(d))
    assert set(got) == want and [r[3] for r in got] == ["third/", "vendor/"]


def test_hubs_of_chains(spark):
    d = data(spark, "o/r a h1 1", "o/r a2 h5 1", "p/s b h1 2", "p/s b2 h5 2", "p/s c h2 3", "q/t d h2 4", "u/v e h2 5", "u/v f h1 5")
    chain = explore.copy_chain(d).collect()
    want = {(o, len({r.OO for r in chain if o == r.O}), len({r.C for r in chain if o == r.O})) for o in {r.O for r in chain}}
    assert set(rows(explore.copy_chain_hubs(d), "O", "n_origins", "n_copiers")) == want == {("p/s", 1, 2)}
    assert rows(explore.copy_chain_hubs(d), "n_copied", "n_copies") == [(2, 2)]


def test_chain_and_phases(spark):
    d = data(spark, "o/r a h1 1", "p/s b h1 2", "p/s c h2 3", "q/t d h2 4", "q/t test/e h5 6")
    assert rows(explore.copy_chain(d), "OO", "O", "C") == [("o/r", "p/s", "q/t")]
    assert dict((r.REPO_OWNER, r.T_COMMIT_TIME) for r in explore.test_phase(d).collect()) == {"o": 1, "p": 3, "q": 6}
    s = {r.column_name: r for r in explore.summary(d).collect()}
    assert s["HASH_CODE"].n_values == 5 and s["COMMIT_TIME"].greatest == "6" and s["HASH_CODE"].mean is None
    assert s["COMMIT_TIME"].mean == 16 / 5 and abs(s["COMMIT_TIME"].stddev - 3.7**0.5) < 1e-9
    every = explore.summaries({"all": d, "none": d.limit(0), "orig": history.orig(d)}).collect()
    assert {(r.frame, r.column_name, r.n_rows) for r in every} >= {("all", "GIT_PATH", 5), ("none", "GIT_PATH", 0), ("orig", "HASH_CODE", 3)}
    assert explore.summary(d.limit(1).select("COMMIT_TIME")).first().stddev is None
    p = explore.copy_phase(data(spark, "o/r a h1 1", "p/s x h0 2", "p/s b h1 3", "p/s y h9 5")).first()
    assert (p.n_repos, p.mean_phase, p.sum_phase) == (1, 0.25, 0.25)
