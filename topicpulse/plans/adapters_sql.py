"""DuckDB text of the derived tables, prefixed to an oracle as WITH clauses."""

from __future__ import annotations

import re

_TS = "make_timestamp(({}) * 1000000)"
_SEEN = "1704067200 + (p_partkey % 90) * 86400"

CTES: dict[str, str] = {
    "articles": f"""
SELECT a.*, round(30.0::DOUBLE * ln(1 + view_count) / ln(1000001) + 40.0::DOUBLE * ln(1 + like_count) / ln(100001)
  + 20.0::DOUBLE * ln(1 + comment_count) / ln(10001) + 10.0::DOUBLE * ln(1 + share_count) / ln(50001), 2) AS heat_score
FROM (SELECT d.doc_id AS id, concat('p', CAST(d.n_chars % 12 AS VARCHAR)) AS platform, md5(d.text) AS platform_id,
 substr(split_part(d.text, chr(10), 1), 1, 60) AS title, d.source AS author,
 concat('https://', d.source, '.example.com/p/', CAST(d.doc_id AS VARCHAR)) AS url, d.text AS content,
 CASE WHEN d.doc_id % 3 = 0 THEN substr(d.text, 1, 120) END AS summary,
 {_TS.format("1704067200 + d.doc_id * 3600")} AS crawl_time,
 CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE {_TS.format("1704067200 + d.doc_id * 3600 - (d.doc_id % 72) * 3600")} END AS publish_time,
 CAST((d.doc_id * 7919) % 1000000 AS BIGINT) AS view_count, CAST((d.doc_id * 104729) % 100000 AS BIGINT) AS like_count,
 CAST((d.doc_id * 1299709) % 10000 AS BIGINT) AS comment_count, CAST((d.doc_id * 15485863) % 50000 AS BIGINT) AS share_count,
 l.doc_id IS NOT NULL AS is_analyzed, d.lang AS language
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) a""",
    "demands": f"""
SELECT p_partkey AS id, concat(p_name, ' ', lower(p_type)) AS title, concat(p_name, ' ', p_brand, ' ', p_type) AS description,
 CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS category, p_brand AS subcategory,
 CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN 'not-json' ELSE concat('["', replace(p_name, ' ', '","'), '"]') END AS tags,
 CAST(1 + p_partkey % 20 AS BIGINT) AS frequency, CAST(p_size AS DOUBLE) / 5 AS importance_score,
 CASE WHEN p_partkey % 3 = 0 THEN 'rising' WHEN p_partkey % 3 = 1 THEN 'stable' ELSE 'declining' END AS trend,
 {_TS.format(_SEEN)} AS first_seen, {_TS.format(_SEEN + " + (p_partkey % 11) * 3600")} AS last_seen,
 CASE WHEN p_partkey % 13 = 0 THEN 'confirmed' ELSE 'new' END AS status FROM part""",
    "article_demand_relations": """
SELECT l_orderkey % (SELECT count(*) FROM documents) AS article_id, l_partkey AS demand_id, max(l_discount) AS relevance_score
FROM lineitem GROUP BY 1, 2""",
    "trend_snapshots": """
SELECT l_partkey AS demand_id, CAST(date_trunc('year', l_shipdate) AS DATE) AS snapshot_date,
 CAST(count(*) AS BIGINT) AS frequency, sum(l_quantity) AS heat_score,
 CAST(CAST(max(l_shipdate) AS DATE) - DATE '1970-01-01' AS BIGINT) AS taken FROM lineitem GROUP BY 1, 2""",
    "hot_comments": """
SELECT conv_id * 100 + turn AS id, conv_id AS article_id, CASE WHEN role <> 'system' THEN role END AS commenter,
 text AS content, CAST((length(text) * 7) % 500 AS BIGINT) AS like_count, turn % 2 = 0 AS is_analyzed FROM conversations""",
    "crawl_logs": """
SELECT event_id AS id, concat('p', CAST(user_id % 12 AS VARCHAR)) AS platform, ts AS start_time,
 CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'stopped_blocked' ELSE 'completed' END AS status,
 CAST(floor(value) AS BIGINT) AS articles_found, CAST(floor(value / 2) AS BIGINT) AS articles_new, props AS last_position FROM events""",
    "demand_relations": """
SELECT least(a, b) AS demand_id_a, greatest(a, b) AS demand_id_b, max(s) AS similarity_score
FROM (SELECT p_partkey AS a, (p_partkey * 7 + 1) % (SELECT count(*) + 5 FROM part) AS b,
             0.5 + CAST(p_size AS DOUBLE) / 100 AS s FROM part) t
WHERE a <> b GROUP BY 1, 2""",
}


def register_cte(name: str, sql: str) -> None:
    """Add a derived input (payloads, responses) that oracles may name."""
    CTES[name] = sql


def _mentioned(sql: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return {name for name in CTES if name in words}


def with_adapters(sql: str) -> str:
    """Prefix ``sql`` with the derived tables it names, directly or through others."""
    needed: set[str] = set()
    pending = _mentioned(sql)
    while pending:
        needed |= pending
        pending = {m for n in pending for m in _mentioned(CTES[n])} - needed
    if not needed:
        return sql
    heads = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    body = sql.strip()
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, flags=re.IGNORECASE)
    if match:
        return f"WITH {match.group(1) or ''}{heads},\n{body[match.end():]}"
    return f"WITH {heads}\n{body}"
