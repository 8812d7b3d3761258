"""DuckDB forms of the queries that SQL can express."""

SQL: dict[str, str] = {
    "op6_line_dedup": """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS found FROM documents),
lines AS (SELECT doc_id, unnest(found) AS line, generate_subscripts(found, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
told AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS dropped FROM keyed k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM told GROUP BY doc_id
""",
}
