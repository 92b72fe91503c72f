"""The same results as SQL for an independent engine. Checksums stand in by md5 prefixes and are never output."""

from __future__ import annotations

_FM = """fm AS (
  SELECT repo_owner AS REPO_OWNER, repository AS REPOSITORY, git_path AS GIT_PATH, NULLIF(lower(trim(hash_code)), '') AS HASH_CODE,
         min(commit_time) AS COMMIT_TIME, NULLIF(lower(trim(commit_id)), '') AS COMMIT_ID
  FROM file_metadata GROUP BY 1, 2, 3, 4, 6)"""

_ALL = _FM + """, headed AS (
  SELECT *, max(COMMIT_TIME) OVER (PARTITION BY REPO_OWNER, REPOSITORY, GIT_PATH) AS HEAD_COMMIT_TIME,
    first_value(HASH_CODE) OVER (PARTITION BY REPO_OWNER, REPOSITORY, GIT_PATH ORDER BY COMMIT_TIME DESC, COMMIT_ID DESC NULLS LAST, HASH_CODE DESC NULLS LAST) AS HEAD_HASH_CODE
  FROM fm), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY HASH_CODE ORDER BY COMMIT_TIME, REPO_OWNER, REPOSITORY, GIT_PATH, COMMIT_ID) AS rn,
    count(*) OVER (PARTITION BY HASH_CODE) AS n
  FROM headed WHERE HASH_CODE IS NOT NULL), all_data AS (
  SELECT h.REPO_OWNER, h.REPOSITORY, h.GIT_PATH, h.HASH_CODE, h.COMMIT_TIME, h.COMMIT_ID, h.HEAD_COMMIT_TIME, h.HEAD_HASH_CODE,
    o.REPO_OWNER AS O_REPO_OWNER, o.REPOSITORY AS O_REPOSITORY, o.GIT_PATH AS O_GIT_PATH, o.COMMIT_TIME AS O_COMMIT_TIME,
    o.HEAD_HASH_CODE AS O_HEAD_HASH_CODE, o.HEAD_COMMIT_TIME AS O_HEAD_COMMIT_TIME, CASE WHEN o.n = 1 THEN true END AS IS_UNIQUE
  FROM headed h LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) o ON h.HASH_CODE = o.HASH_CODE), orig AS (
  SELECT DISTINCT O_REPO_OWNER, O_REPOSITORY, O_GIT_PATH, O_COMMIT_TIME, HASH_CODE, O_HEAD_COMMIT_TIME, O_HEAD_HASH_CODE, IS_UNIQUE
  FROM all_data WHERE HASH_CODE IS NOT NULL AND COMMIT_TIME = O_COMMIT_TIME), copy_ AS (
  SELECT * EXCLUDE (IS_UNIQUE, COMMIT_ID) FROM all_data
  WHERE HASH_CODE IS NOT NULL AND COMMIT_TIME <> O_COMMIT_TIME
    AND (REPO_OWNER <> O_REPO_OWNER OR REPOSITORY <> O_REPOSITORY OR GIT_PATH <> O_GIT_PATH)
    AND NOT (O_HEAD_HASH_CODE IS NULL AND O_HEAD_COMMIT_TIME = COMMIT_TIME)), head_copy AS (
  SELECT * FROM copy_ WHERE COMMIT_TIME = HEAD_COMMIT_TIME)"""


def _tidy(p: str) -> str:
    return f"regexp_replace(regexp_replace({p}, '/+', '/', 'g'), '(.)/$', '\\1')"


def _folder(p: str) -> str:
    t = _tidy(p)
    return f"CASE WHEN {t} = '/' THEN '' WHEN regexp_matches({t}, '^/[^/]*$') THEN '/' ELSE regexp_extract({t}, '^(.*)/[^/]*$', 1) END"


def _name(p: str) -> str:
    t = _tidy(p)
    return f"CASE WHEN {t} <> '/' THEN regexp_extract({t}, '([^/]*)$', 1) END"


def _crc(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


_FOLDERS = f""", cand AS (
  SELECT *, {_crc('HASH_CODE')} AS crc, {_folder('GIT_PATH')} AS FOLDER, {_crc(_name('GIT_PATH'))} AS name
  FROM all_data WHERE REPO_OWNER IN (SELECT O_REPO_OWNER FROM head_copy) AND REPOSITORY IN (SELECT O_REPOSITORY FROM head_copy)), lagged AS (
  SELECT *, lag(crc) OVER (PARTITION BY REPO_OWNER, REPOSITORY, GIT_PATH ORDER BY COMMIT_TIME, COMMIT_ID NULLS FIRST, HASH_CODE NULLS FIRST) AS prev FROM cand), deltas AS (
  SELECT REPO_OWNER, REPOSITORY, COMMIT_TIME, FOLDER, sum(coalesce(crc, 0) - coalesce(prev, 0)) AS dh,
    sum(CASE WHEN prev IS NULL AND crc IS NULL THEN 0 WHEN prev IS NULL THEN name WHEN crc IS NULL THEN -name ELSE 0 END) AS dn,
    sum(CASE WHEN prev IS NULL AND crc IS NULL THEN 0 WHEN prev IS NULL THEN 1 WHEN crc IS NULL THEN -1 ELSE 0 END) AS df
  FROM lagged GROUP BY 1, 2, 3, 4), states AS (
  SELECT REPO_OWNER, REPOSITORY, COMMIT_TIME, FOLDER, sum(dh) OVER w AS sh, sum(dn) OVER w AS sn, CAST(sum(df) OVER w AS BIGINT) AS nf
  FROM deltas WINDOW w AS (PARTITION BY REPO_OWNER, REPOSITORY, FOLDER ORDER BY COMMIT_TIME)), firsts AS (
  SELECT REPO_OWNER, REPOSITORY, FOLDER, sh, sn, nf, min(COMMIT_TIME) AS COMMIT_TIME FROM states WHERE nf > 0 GROUP BY 1, 2, 3, 4, 5, 6), ranked_orig AS (
  SELECT *, row_number() OVER (PARTITION BY sh, sn, nf ORDER BY COMMIT_TIME, REPO_OWNER, REPOSITORY, FOLDER) AS ROW_NUM FROM firsts), copied AS (
  SELECT REPO_OWNER, REPOSITORY, COMMIT_TIME, FOLDER, sum(crc) AS sh, sum(name) AS sn, count(*) AS nf
  FROM (SELECT DISTINCT REPO_OWNER, REPOSITORY, GIT_PATH, COMMIT_TIME, {_crc('HASH_CODE')} AS crc, {_folder('GIT_PATH')} AS FOLDER, {_crc(_name('GIT_PATH'))} AS name FROM head_copy)
  GROUP BY 1, 2, 3, 4), matched AS (
  SELECT c.REPO_OWNER, c.REPOSITORY, c.COMMIT_TIME, c.FOLDER, c.nf AS n_files, o.REPO_OWNER AS O_REPO_OWNER, o.REPOSITORY AS O_REPOSITORY,
    o.FOLDER AS O_FOLDER, o.COMMIT_TIME AS O_COMMIT_TIME, o.ROW_NUM,
    row_number() OVER (PARTITION BY c.REPO_OWNER, c.REPOSITORY, c.COMMIT_TIME, c.FOLDER ORDER BY o.ROW_NUM NULLS LAST) AS k
  FROM copied c LEFT JOIN ranked_orig o ON c.sh = o.sh AND c.sn = o.sn AND c.nf = o.nf AND o.ROW_NUM <= 100 AND c.COMMIT_TIME > o.COMMIT_TIME
    AND (c.REPO_OWNER <> o.REPO_OWNER OR c.REPOSITORY <> o.REPOSITORY)), examples AS (
  SELECT * EXCLUDE (k) FROM matched WHERE k = 1)"""


def _label(*rules: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(FOLDER, '{t}') THEN '{n}'" for t, n in rules) + " ELSE 'OTHERS' END"


_A, _F = f"WITH {_ALL} ", f"WITH {_ALL}{_FOLDERS} "

_REPOS = """ SELECT regexp_extract(RESPONSE, 'git://github\\.com/([^/]+)/(.+?)(\\.git|")', 1) AS REPO_OWNER, regexp_extract(RESPONSE, 'git://github\\.com/([^/]+)/(.+?)(\\.git|")', 2) AS REPOSITORY
      FROM names JOIN answers ON PACKAGE = CASE WHEN REPO IN (SELECT PACKAGE FROM answers) THEN REPO ELSE split_part(REPO, '.', 1) END"""


_NAMES = """, names AS (SELECT DISTINCT REPO FROM (SELECT unnest(regexp_extract_all(O_GIT_PATH, 'node_modules/([^/]*)', 1)) AS REPO FROM orig)), answers AS (
      SELECT DISTINCT repository AS PACKAGE, '"url":"git://github.com/' || min(repo_owner) || '/' || repository || '.git"' AS RESPONSE FROM file_metadata GROUP BY repository)"""


def _summary(frame: str, columns: str) -> list[str]:
    of = {"all_data": "all_data", "orig": "orig", "copy": "copy_"}[frame]
    number = lambda f, c: f"round({f}({c}), 1)" if c.endswith("TIME") else "CAST(NULL AS DOUBLE)"
    return [
        f"SELECT '{frame}' AS frame, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, {number('avg', c)} AS mean, {number('stddev_samp', c)} AS stddev, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM {of}"
        for c in columns.split()
    ]


_ORIGIN = "O_REPO_OWNER O_REPOSITORY O_GIT_PATH O_COMMIT_TIME O_HEAD_HASH_CODE O_HEAD_COMMIT_TIME"
_BASE = "REPO_OWNER REPOSITORY GIT_PATH HASH_CODE COMMIT_TIME HEAD_COMMIT_TIME HEAD_HASH_CODE " + _ORIGIN

ORACLE = {
    "q00_lake_read": f"WITH {_FM} SELECT * FROM fm",
    "q01_all_data": _A + "SELECT * EXCLUDE (COMMIT_ID) FROM all_data",
    "q02_orig": _A + "SELECT * FROM orig",
    "q03_copy": _A + "SELECT * FROM copy_",
    "q04_head_copy": _A + "SELECT * FROM head_copy",
    "q05_all_paths_count": _A + "SELECT count(*) AS n_paths FROM (SELECT DISTINCT REPO_OWNER, REPOSITORY, GIT_PATH FROM all_data WHERE HASH_CODE IS NOT NULL AND COMMIT_TIME = HEAD_COMMIT_TIME)",
    "q06_orig_paths_count": _A + "SELECT IS_UNIQUE, count(*) AS n_paths FROM (SELECT DISTINCT O_REPO_OWNER, O_REPOSITORY, O_GIT_PATH, IS_UNIQUE FROM orig WHERE O_COMMIT_TIME = O_HEAD_COMMIT_TIME) GROUP BY 1",
    "q07_copy_paths_count": _A + "SELECT count(*) AS n_paths FROM (SELECT DISTINCT REPO_OWNER, REPOSITORY, GIT_PATH FROM head_copy)",
    "q08_divergent_copy_count": _A
    + """SELECT IS_UNIQUE, count(*) AS n_paths FROM (SELECT DISTINCT REPO_OWNER, REPOSITORY, GIT_PATH FROM copy_ WHERE COMMIT_TIME <> HEAD_COMMIT_TIME) d
      JOIN (SELECT * FROM orig WHERE O_COMMIT_TIME = O_HEAD_COMMIT_TIME) o ON d.REPO_OWNER = o.O_REPO_OWNER AND d.REPOSITORY = o.O_REPOSITORY AND d.GIT_PATH = o.O_GIT_PATH GROUP BY 1""",
    "q09_active_repo_obsolete_copy_count": _A
    + """SELECT IS_ACTIVE, count(*) AS n_paths FROM (SELECT DISTINCT c.REPO_OWNER, c.REPOSITORY, c.GIT_PATH, r.t > c.O_HEAD_COMMIT_TIME AS IS_ACTIVE FROM head_copy c
      JOIN (SELECT REPO_OWNER, REPOSITORY, max(COMMIT_TIME) AS t FROM all_data GROUP BY 1, 2) r ON c.REPO_OWNER = r.REPO_OWNER AND c.REPOSITORY = r.REPOSITORY
      WHERE c.O_HEAD_HASH_CODE <> c.HASH_CODE) GROUP BY 1""",
    "q10_ranked_orig_folder_hash": _F + "SELECT REPO_OWNER AS O_REPO_OWNER, REPOSITORY AS O_REPOSITORY, FOLDER AS O_FOLDER, COMMIT_TIME AS O_COMMIT_TIME, nf AS n_files, ROW_NUM FROM ranked_orig",
    "q11_copy_folder_hash": _F + "SELECT REPO_OWNER, REPOSITORY, COMMIT_TIME, FOLDER, nf AS n_files FROM copied",
    "q12_copy_as_import_examples": _F + "SELECT * FROM examples",
    "q13_copy_as_import_count": _F
    + f"""SELECT IS_COPY_AS_IMPORT, PACKAGER_MANAGER_NAME, CAST(sum(n_files) AS BIGINT) AS n_files FROM (SELECT DISTINCT REPO_OWNER, REPOSITORY, FOLDER, n_files,
      O_REPO_OWNER IS NOT NULL AS IS_COPY_AS_IMPORT, {_label(('www/', 'WWW'), ('node_modules/', 'NPM'), ('bower_components/', 'BOWER'), ('.bower-cache/', 'BOWER'))} AS PACKAGER_MANAGER_NAME FROM examples) GROUP BY 1, 2""",
    "q14_popular_other_folders": _F
    + f"""SELECT FOLDER, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(FOLDER, '/+$', ''), '/')) AS FOLDER FROM (SELECT DISTINCT REPO_OWNER, REPOSITORY, FOLDER, n_files FROM examples)
      WHERE {_label(('node_modules/', 'NPM'), ('bower_components/', 'BOWER'), ('.bower-cache/', 'BOWER'), ('bower/', 'BOWER'), ('www/', 'WWW'))} = 'OTHERS') GROUP BY 1 HAVING count(*) > 5""",
    "q15_unidentified_node_copies": _F
    + """SELECT DISTINCT REPO_OWNER, REPOSITORY, GIT_PATH FROM head_copy h WHERE contains(GIT_PATH, 'node_modules/')
      AND NOT EXISTS (SELECT 1 FROM examples e WHERE e.O_REPO_OWNER IS NOT NULL AND e.REPO_OWNER = h.REPO_OWNER AND e.REPOSITORY = h.REPOSITORY)""",
    "q15b_unidentified_node_copies_literal": _F
    + """SELECT DISTINCT REPO_OWNER, REPOSITORY, GIT_PATH FROM head_copy h WHERE contains(GIT_PATH, 'node_modules/')
      AND NOT EXISTS (SELECT 1 FROM examples e WHERE e.REPO_OWNER = h.REPO_OWNER AND e.REPOSITORY = h.REPOSITORY)""",
    "q16_essential_node_packages": _A + "SELECT DISTINCT REPO FROM (SELECT unnest(regexp_extract_all(O_GIT_PATH, 'node_modules/([^/]*)', 1)) AS REPO FROM orig)",
    "q17_essential_node_git_repos": _A + _NAMES + _REPOS,
    "q17b_essential_node_git_repos_of_file": _A + _NAMES + ", kept AS (SELECT * FROM names WHERE trim(REPO) <> '')" + _REPOS.replace("FROM names", "FROM kept"),
    "q18b_semi_filter": _A + "SELECT count(*) AS n FROM all_data WHERE REPO_OWNER IN (SELECT O_REPO_OWNER FROM head_copy) AND REPOSITORY IN (SELECT O_REPOSITORY FROM head_copy)",
    "q18c_bloom_filter": _A + "SELECT count(DISTINCT HASH_CODE) AS n_members, CAST(0 AS BIGINT) AS n_missed, true AS within_rate FROM copy_",
    "q19_summary": _A + " UNION ALL ".join(_summary("all_data", f"{_BASE} IS_UNIQUE") + _summary("orig", f"HASH_CODE {_ORIGIN} IS_UNIQUE") + _summary("copy", _BASE)),
    "q20_true_path_copy": _A
    + """SELECT REPO_OWNER, REPOSITORY, COMMIT_TIME, substr(GIT_PATH, 1, length(GIT_PATH) - length(O_GIT_PATH)) AS GIT_PATH_PREFIX, O_REPO_OWNER, O_REPOSITORY, max(O_COMMIT_TIME) AS O_COMMIT_TIME
      FROM head_copy WHERE (REPO_OWNER <> O_REPO_OWNER OR REPOSITORY <> O_REPOSITORY) AND length(GIT_PATH) > length(O_GIT_PATH) AND contains(GIT_PATH, O_GIT_PATH) GROUP BY 1, 2, 3, 4, 5, 6""",
    "q21_copy_chain": _A
    + """, c AS (SELECT O_REPO_OWNER || '/' || O_REPOSITORY AS O, REPO_OWNER || '/' || REPOSITORY AS C, count(*) AS n FROM copy_ GROUP BY 1, 2)
      SELECT b.O AS OO, a.O, a.C, a.n AS n_copies, b.n AS n_origin_copies FROM c a JOIN c b ON a.O = b.C""",
    "q21b_copy_chain_hubs": _A
    + """, c AS (SELECT O_REPO_OWNER || '/' || O_REPOSITORY AS O, REPO_OWNER || '/' || REPOSITORY AS C, count(*) AS n FROM copy_ GROUP BY 1, 2)
      SELECT O, n_origins, n_copiers, n_copied, n_copies FROM (SELECT O, count(*) AS n_copiers, CAST(sum(n) AS BIGINT) AS n_copies FROM c GROUP BY 1) JOIN (SELECT C AS O, count(*) AS n_origins, CAST(sum(n) AS BIGINT) AS n_copied FROM c GROUP BY 1) USING (O)""",
    "q22_copy_phase": _A
    + """SELECT n_commits, n_paths, round(avg((t - a) / (b - a + 1)), 6) AS mean_phase, round(sum((t - a) / (b - a + 1)), 6) AS sum_phase, count(*) AS n_repos FROM (SELECT REPO_OWNER, REPOSITORY, min(COMMIT_TIME) AS a, max(COMMIT_TIME) AS b,
      count(DISTINCT COMMIT_TIME) AS n_commits, count(DISTINCT GIT_PATH) AS n_paths FROM all_data GROUP BY 1, 2) r JOIN (SELECT REPO_OWNER, REPOSITORY, min(COMMIT_TIME) AS t FROM copy_ GROUP BY 1, 2) c USING (REPO_OWNER, REPOSITORY) GROUP BY 1, 2""",
    "q23_test_phase": _A + "SELECT REPO_OWNER, REPOSITORY, coalesce(min(COMMIT_TIME) FILTER (WHERE contains(lower(GIT_PATH), 'test/')), max(COMMIT_TIME)) AS T_COMMIT_TIME FROM all_data GROUP BY 1, 2",
    "p3_found": """WITH once AS (SELECT repo_owner, repository, git_path, NULLIF(lower(trim(hash_code)), '') AS hash_code, NULLIF(lower(trim(commit_id)), '') AS commit_id, min(commit_time) AS t
      FROM file_metadata GROUP BY 1, 2, 3, 4, 5), held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_owner, repository, git_path, t ORDER BY commit_id DESC NULLS LAST, hash_code DESC NULLS LAST) AS k FROM once) WHERE k = 1),
      marked AS (SELECT *, CASE WHEN k0 = 1 OR hash_code IS DISTINCT FROM prev THEN 1 ELSE 0 END AS new FROM (SELECT *, lag(hash_code) OVER w AS prev, row_number() OVER w AS k0 FROM held WINDOW w AS (PARTITION BY repo_owner, repository, git_path ORDER BY t))),
      starts AS (SELECT *, lead(t) OVER (PARTITION BY repo_owner, repository, git_path ORDER BY t) AS until FROM marked WHERE new = 1)
      SELECT repo_owner, repository, git_path, hash_code, t AS valid_from, coalesce(until, -1) AS valid_to FROM starts WHERE hash_code IS NOT NULL""",
    "p6_found": """WITH k AS (SELECT 'repo_owner' AS field_name, repo_owner AS key_value FROM file_metadata UNION ALL SELECT 'repository', repository FROM file_metadata UNION ALL SELECT 'hash_code', lower(trim(hash_code)) FROM file_metadata),
      n AS (SELECT field_name, key_value, count(*) AS n FROM k WHERE trim(key_value) <> '' GROUP BY 1, 2)
      SELECT field_name, key_value FROM (SELECT *, sum(n) OVER (PARTITION BY field_name) AS total FROM n) WHERE n >= 0.05 * total""",
    "p6_keys": """WITH k AS (SELECT 'repo_owner' AS field_name, repo_owner AS key_value, commit_time AS t FROM file_metadata UNION ALL SELECT 'repository', repository, commit_time FROM file_metadata UNION ALL SELECT 'hash_code', lower(trim(hash_code)), commit_time FROM file_metadata)
      SELECT field_name, key_value, count(*) AS n_rows, min(t) AS first_at, max(t) AS last_at, coalesce(max(gap), 0) AS longest_gap
      FROM (SELECT *, t - lag(t) OVER (PARTITION BY field_name, key_value ORDER BY t) AS gap FROM k WHERE trim(key_value) <> '') GROUP BY 1, 2""",
    "p7_found": """SELECT 'commit_messages' AS target_table, row_id FROM file_metadata WHERE lower(trim(commit_id)) NOT IN (SELECT lower(trim(commit_id)) FROM commit_messages WHERE deleted_at IS NULL AND commit_id IS NOT NULL)
      UNION ALL SELECT 'contents', row_id FROM file_metadata WHERE lower(trim(hash_code)) <> '' AND lower(trim(hash_code)) NOT IN (SELECT lower(trim(hash_code)) FROM contents WHERE deleted_at IS NULL AND hash_code IS NOT NULL)""",
    "p7_report": """WITH refs AS (SELECT 'commit_messages' AS target_table, coalesce(lower(trim(commit_id)), '') AS key, commit_time FROM file_metadata UNION ALL SELECT 'contents', lower(trim(hash_code)), commit_time FROM file_metadata WHERE lower(trim(hash_code)) <> ''),
      live AS (SELECT DISTINCT 'commit_messages' AS target_table, lower(trim(commit_id)) AS key FROM commit_messages WHERE deleted_at IS NULL UNION ALL SELECT DISTINCT 'contents', lower(trim(hash_code)) FROM contents WHERE deleted_at IS NULL)
      SELECT r.target_table, strftime(make_timestamp(commit_time * 1000000), '%Y-%m') AS month, count(*) AS n_references, count(*) FILTER (WHERE l.key IS NULL) AS n_orphans, count(DISTINCT CASE WHEN l.key IS NULL THEN r.key END) AS n_orphan_keys
      FROM refs r LEFT JOIN live l ON r.target_table = l.target_table AND r.key = l.key GROUP BY 1, 2""",
}
