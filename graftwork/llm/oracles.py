"""DuckDB SQL for the queries that SQL can express."""

URLS = r"""
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), listed(host) AS (
  SELECT n || '.example.' || t FROM (VALUES ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(n), (VALUES ('com'), ('net'), ('org')) b(t)
), judged AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    EXISTS (SELECT 1 FROM listed l WHERE p.host = l.host OR ends_with(p.host, '.' || l.host)) AS bad,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS nth
  FROM parsed p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM judged WHERE nth = 1
"""

LINES = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, generate_subscripts(lines, 1) AS i, unnest(lines) AS line,
    translate(trim(unnest(lines), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs
), hot AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (
  SELECT r, count(*) FILTER (key IN (SELECT key FROM hot)) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM hot)), '') AS text
  FROM lines GROUP BY r
)
SELECT doc_id, len(lines) AS n_lines, n_dropped, sha256(text) AS kept_sha256 FROM docs JOIN kept USING (r)
"""

WARC = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY coalesce(html, '')) THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""

ORACLES = {"op2_line_dedup": LINES, "op4_warc": WARC, "op5_url_filters": URLS}
