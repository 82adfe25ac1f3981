"""Schemas and declared defaults of the seven stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def _struct(text: str) -> T.StructType:
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {
    "articles": _struct(
        "id BIGINT, platform STRING, platform_id STRING, title STRING, author STRING, url STRING,"
        " content STRING, summary STRING, publish_time TIMESTAMP_NTZ, crawl_time TIMESTAMP_NTZ,"
        " heat_score DOUBLE, view_count BIGINT, like_count BIGINT, comment_count BIGINT,"
        " share_count BIGINT, is_analyzed BOOLEAN, raw_html STRING, language STRING"
    ),
    "demands": _struct(
        "id BIGINT, title STRING, description STRING, category STRING, subcategory STRING,"
        " tags STRING, frequency BIGINT, importance_score DOUBLE, trend STRING,"
        " first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ, status STRING, notes STRING,"
        " semantic_vector STRING, language STRING"
    ),
    "article_demand_relations": _struct(
        "article_id BIGINT, demand_id BIGINT, relevance_score DOUBLE, context_snippet STRING"
    ),
    "hot_comments": _struct(
        "id BIGINT, article_id BIGINT, platform STRING, commenter STRING, content STRING,"
        " like_count BIGINT, crawl_time TIMESTAMP_NTZ, is_analyzed BOOLEAN"
    ),
    "crawl_logs": _struct(
        "id BIGINT, platform STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ,"
        " status STRING, articles_found BIGINT, articles_new BIGINT, error_message STRING,"
        " last_position STRING"
    ),
    "trend_snapshots": _struct(
        "demand_id BIGINT, snapshot_date DATE, frequency BIGINT, heat_score DOUBLE, taken BIGINT"
    ),
    "demand_relations": _struct(
        "demand_id_a BIGINT, demand_id_b BIGINT, similarity_score DOUBLE"
    ),
}

# Columns without which a stored row is bad.
REQUIRED: dict[str, list[str]] = {
    "articles": ["id", "platform", "title", "url"],
    "demands": ["id", "title"],
    "article_demand_relations": ["article_id", "demand_id"],
    "hot_comments": ["id", "article_id", "platform", "content"],
    "crawl_logs": ["id", "platform", "start_time"],
    "trend_snapshots": ["demand_id", "snapshot_date"],
    "demand_relations": ["demand_id_a", "demand_id_b"],
}

# Literal defaults; columns whose default is computed at insert time have none.
DEFAULTS: dict[str, dict[str, object]] = {
    "articles": {
        "heat_score": 0.0,
        "view_count": 0,
        "like_count": 0,
        "comment_count": 0,
        "share_count": 0,
        "is_analyzed": False,
        "language": "zh",
    },
    "demands": {
        "frequency": 1,
        "importance_score": 0.0,
        "trend": "stable",
        "status": "new",
        "language": "zh",
    },
    "article_demand_relations": {"relevance_score": 0.0},
    "hot_comments": {"like_count": 0, "is_analyzed": False},
    "crawl_logs": {"articles_found": 0, "articles_new": 0},
    "trend_snapshots": {"frequency": 0, "heat_score": 0.0},
    "demand_relations": {"similarity_score": 0.0},
}

# The columns every platform normaliser produces.
ARTICLE_MODEL = [
    "platform",
    "platform_id",
    "title",
    "url",
    "author",
    "view_count",
    "like_count",
    "comment_count",
    "share_count",
    "publish_time",
    "summary",
]
