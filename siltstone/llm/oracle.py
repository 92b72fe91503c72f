"""SQL for the queries of this subpackage that SQL can express."""

_SPANS = """WITH live AS (SELECT lower(trim(hash_code)) AS h, max(coalesce(contents, '')) AS t FROM contents WHERE deleted_at IS NULL AND trim(hash_code) <> '' GROUP BY 1),
      w AS (SELECT h, i, md5(substr(t, CAST(i + 1 AS BIGINT), 200)) AS k FROM (SELECT h, t, unnest(range(0, length(t) - 199)) AS i FROM live WHERE length(t) >= 200)),
      hit AS (SELECT h, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(DISTINCT h) > 1)),
      marked AS (SELECT h, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY h ORDER BY i)),
      numbered AS (SELECT h, i, sum(new) OVER (PARTITION BY h ORDER BY i) AS n FROM marked),
      spans AS (SELECT h AS hash_code, min(i) AS span_start, max(i) + 200 AS span_end FROM numbered GROUP BY h, n)"""

ORACLE = {
    "p1_found": """WITH k AS (SELECT row_id, lower(trim(hash_code)) AS h FROM file_metadata WHERE trim(hash_code) <> '')
      SELECT DISTINCT row_id FROM (SELECT row_id, h, min(row_id) OVER (PARTITION BY h) AS first FROM k)
      WHERE row_id > first OR h IN (SELECT lower(trim(hash_code)) FROM hash_index WHERE trim(hash_code) <> '')""",
    "p1_totals": """SELECT count(DISTINCT h) AS n_distinct_keys, CAST(0 AS BIGINT) AS n_wrong FROM (SELECT lower(trim(hash_code)) AS h FROM file_metadata UNION ALL SELECT lower(trim(hash_code)) FROM hash_index) WHERE h <> ''""",
    "p2_found": _SPANS + " SELECT * FROM spans",
    "p2_amounts": _SPANS
    + """ SELECT h AS hash_code, length(t) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, CASE WHEN length(t) > 0 THEN coalesce(n, 0) / length(t) ELSE 0.0 END AS share
      FROM live LEFT JOIN (SELECT hash_code, sum(span_end - span_start) AS n FROM spans GROUP BY 1) ON h = hash_code""",
    # sizes by a tokenizer are beyond SQL; that every document is packed, whole, and none in vain is not
    "p9_violations": "SELECT count(*) FILTER (WHERE text <> '') AS n_documents, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_incomplete, CAST(0 AS BIGINT) AS n_overfull FROM documents",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
