"""Schemas of the nested snapshot and of all tables. Names and types of all columns, and the keys, are those of stored data."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType

_TYPES: dict[str, DataType] = {
    "STRING": StringType(), "BIGINT": LongType(), "BOOLEAN": BooleanType(), "DOUBLE": DoubleType(), "ARRAY<STRING>": ArrayType(StringType()), "ARRAY<DOUBLE>": ArrayType(DoubleType()),
    "MAP<STRING,STRING>": MapType(StringType(), StringType()),
}


def struct(text: str, **nested: DataType) -> StructType:
    """`name TYPE, ...` as a schema, without a session; nested fields are given by name."""
    pairs = (x.split() for x in text.split(", ") if x.strip())
    return StructType([StructField(n, nested[n] if n in nested else _TYPES[t]) for n, t in pairs])


_AUTHOR = struct("author_id STRING, name STRING, profile_url STRING")
_COMMENT = struct(
    "comment_id STRING, platform STRING, parent_post_id STRING, parent_entity_type STRING, parent_entity_id STRING, parent_comment_id STRING, reply_to_message_id STRING, thread_root_post_id STRING, origin_post_id STRING, "
    "created_at STRING, message STRING, permalink STRING, reactions BIGINT, reaction_breakdown_json STRING, source_collector STRING, depth BIGINT, raw_path STRING, author NESTED", author=_AUTHOR,
)
_MEDIA = struct("media_id STRING, owner_post_id STRING, media_type STRING, title STRING, url STRING, preview_url STRING")
_POST = struct(
    "post_id STRING, platform STRING, source_id STRING, origin_post_id STRING, origin_external_id STRING, origin_permalink STRING, propagation_kind STRING, is_propagation BOOLEAN, created_at STRING, message STRING, permalink STRING, "
    "reactions BIGINT, shares BIGINT, comments_count BIGINT, views BIGINT, forwards BIGINT, reply_count BIGINT, has_media BOOLEAN, media_type STRING, reaction_breakdown_json STRING, source_collector STRING, raw_path STRING, "
    "author NESTED, media_refs NESTED, comments NESTED", author=_AUTHOR, media_refs=ArrayType(_MEDIA), comments=ArrayType(_COMMENT),
)
_SOURCE = struct(
    "platform STRING, source_id STRING, source_name STRING, source_url STRING, source_type STRING, about STRING, followers_count BIGINT, fan_count BIGINT, discussion_chat_id STRING, discussion_chat_name STRING, "
    "discussion_linked BOOLEAN, filtered_service_message_count BIGINT, source_collector STRING, raw_path STRING"
)
#: One run of a collector: the source and its posts, each with its comments and media.
MANIFEST = struct(
    "run_id STRING, collected_at STRING, requested_date_start STRING, requested_date_end STRING, collector STRING, mode STRING, status STRING, fallback_used BOOLEAN, warnings ARRAY<STRING>, cursors MAP<STRING,STRING>, "
    "source NESTED, posts NESTED", source=_SOURCE, posts=ArrayType(_POST),
)

_COUNTS = "reactions BIGINT, shares BIGINT, comments_count BIGINT, views BIGINT, forwards BIGINT, reply_count BIGINT, has_media BOOLEAN, media_type STRING, reaction_breakdown_json STRING"
_SCOPE = "parent_post_id STRING, parent_entity_type STRING, parent_entity_id STRING, parent_comment_id STRING, reply_to_message_id STRING, thread_root_post_id STRING, origin_post_id STRING"
_ORIGIN = "platform STRING, source_id STRING, origin_post_id STRING, origin_external_id STRING, origin_permalink STRING, propagation_kind STRING"
TABLES = {
    name: struct(ddl)
    for name, ddl in {
        "posts": f"post_id STRING, {_ORIGIN}, is_propagation BOOLEAN, author_id STRING, created_at STRING, message STRING, permalink STRING, {_COUNTS}, source_collector STRING, raw_path STRING, run_id STRING",
        "propagations": f"propagation_id STRING, {_ORIGIN}, author_id STRING, created_at STRING, message STRING, permalink STRING, {_COUNTS}, source_collector STRING, raw_path STRING, run_id STRING",
        "propagation_edges": "propagation_id STRING, origin_post_id STRING, origin_external_id STRING, propagation_kind STRING, platform STRING, run_id STRING",
        "comments": f"comment_id STRING, platform STRING, {_SCOPE}, author_id STRING, created_at STRING, message STRING, depth BIGINT, permalink STRING, reactions BIGINT, reaction_breakdown_json STRING, source_collector STRING, raw_path STRING, run_id STRING",
        "comment_edges": f"comment_id STRING, {_SCOPE}, depth BIGINT, run_id STRING",
        "authors": "author_id STRING, name STRING, profile_url STRING, source_collector STRING, run_id STRING",
        "media_refs": "media_id STRING, owner_post_id STRING, media_type STRING, title STRING, url STRING, preview_url STRING, run_id STRING",
        "collection_runs": "run_id STRING, collected_at STRING, collector STRING, mode STRING, status STRING, fallback_used BOOLEAN, warning_count BIGINT, warning_messages ARRAY<STRING>, post_count BIGINT, propagation_count BIGINT, comment_count BIGINT, platform STRING, source_id STRING, source_name STRING, source_type STRING, discussion_linked BOOLEAN, filtered_service_message_count BIGINT, source_run_count BIGINT, source_run_ids ARRAY<STRING>",
        "analysis_runs": "run_id STRING, embedding_provider STRING, llm_provider STRING, item_counts STRING, created_at STRING",
        "detected_languages": "run_id STRING, item_type STRING, item_id STRING, language STRING, confidence DOUBLE, method STRING",
        "cluster_memberships": "run_id STRING, item_type STRING, item_id STRING, cluster_id STRING",
        "narrative_clusters": "run_id STRING, item_type STRING, cluster_id STRING, label STRING, description STRING, top_keywords ARRAY<STRING>, exemplar_ids ARRAY<STRING>",
        "stance_labels": "run_id STRING, item_type STRING, item_id STRING, side_id STRING, label STRING, confidence DOUBLE, model_name STRING",
        "support_metrics": "run_id STRING, scope_type STRING, scope_id STRING, side_id STRING, support_count BIGINT, oppose_count BIGINT, neutral_count BIGINT, unclear_count BIGINT, support_ratio DOUBLE, net_support BIGINT",
        "embedding_cache": "provider_key STRING, text_hash STRING, text STRING, embedding ARRAY<DOUBLE>, created_at STRING",
        "stance_cache": "llm_key STRING, text_hash STRING, text STRING, side_id STRING, label STRING, confidence DOUBLE, model_name STRING, created_at STRING",
    }.items()
}
#: Upsert keys. Those of collected tables have no run: the last run that saw a row owns it.
KEYS = {
    "posts": ["post_id"], "propagations": ["propagation_id"], "propagation_edges": ["propagation_id"], "comments": ["comment_id"], "comment_edges": ["comment_id"],
    "authors": ["author_id"], "media_refs": ["media_id"], "collection_runs": ["run_id"], "analysis_runs": ["run_id"], "detected_languages": ["run_id", "item_type", "item_id"],
    "cluster_memberships": ["run_id", "item_type", "item_id"], "narrative_clusters": ["run_id", "item_type", "cluster_id"], "stance_labels": ["run_id", "item_type", "item_id", "side_id"],
    "support_metrics": ["run_id", "scope_type", "scope_id", "side_id"], "embedding_cache": ["provider_key", "text_hash"], "stance_cache": ["llm_key", "text_hash", "side_id"],
}
