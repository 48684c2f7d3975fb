"""Explicit schemas of the memory model. Times are microseconds since the epoch; 0 means none or open."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "i": T.IntegerType(), "v": T.ArrayType(T.DoubleType()), "a": T.ArrayType(T.StringType())}


def schema(text: str) -> T.StructType:
    """A schema from "name:kind" words; kinds: s string, l long, d double, b boolean, i int, v vector, a strings."""
    fields = []
    for word in text.split():
        name, _, kind = word.partition(":")
        fields.append(T.StructField(name, _KINDS[kind or "s"]))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "memory": schema(
        "id workspace_id peer_id observer_id memory_type content summary context entities_json confidence:d source_session_id source_message_id"
        " is_active:b created_at:l expires_at:l updated_at:l tier access_count:l strength:d version:l valid_from:l valid_to:l parent_directory_id"
        " consolidated_to trust_score:d feedback_count:l user_scope source_url"
    ),
    "search_index": schema("id workspace_id entity_type entity_id content embedding:v tokens:a created_at:l"),
    "term_index": schema("term workspace_id entity_type entity_id term_frequency:l doc_length:l"),
    "kg_node": schema("id workspace_id node_type label summary metadata_json community_id:l stale_since:l created_at:l updated_at:l"),
    "kg_edge": schema("id workspace_id source_node_id target_node_id relation weight:d confidence metadata_json created_at:l valid_at:l invalid_at:l version:l edge_group_id"),
    "kg_community": schema("id workspace_id community_id:l name summary node_count:l"),
    "fact_triple": schema("id workspace_id subject predicate object confidence:d tier is_active:b created_at:l"),
    "workspace": schema("id name context created_at:l"),
    "space_permission": schema("workspace_id account_id permission"),
    "peer": schema("id workspace_id name peer_type created_at:l"),
    "profile": schema("id workspace_id peer_id facts_json preferences_json updated_at:l"),
    "session": schema("id workspace_id name summary metadata created_at:l updated_at:l"),
    "session_participant": schema("session_id peer_id joined_at:l"),
    "message": schema("id session_id peer_id role content created_at:l"),
    "agent_step": schema("id session_id step_type content created_at:l"),
    "document": schema("id workspace_id title content created_at:l"),
    "doc_chunk": schema("id document_id chunk_index:i content"),
    "note": schema("id workspace_id title content parent_id created_at:l updated_at:l"),
    "note_backlink": schema("source_note_id target_note_id display_text"),
    "note_block": schema("id note_id block_index:i block_type heading_level:i task_state indent:i content"),
    "tag": schema("id workspace_id name"),
    "memory_tag": schema("workspace_id memory_id tag_id"),
    "entity_link": schema("id workspace_id entity_name entity_type aliases_json mention_count:l first_seen:l last_seen:l description"),
    "veracity_evidence": schema("memory_id alpha:d beta:d positive:l negative:l updated_at:l"),
    "memory_feedback": schema("id memory_id workspace_id peer_id score:l created_at:l"),
    "review_item": schema("id memory_id user_id easiness_factor:d interval_days:l repetitions:l next_review_at:l grade_sum:l grade_count:l is_active:b"),
    "change_event": schema("id table_name operation record_id data_json created_at:l workspace_id"),
    "background_job": schema("id workspace_id job_type status priority:l dedup_key created_at:l"),
    "context_directory": schema("id workspace_id parent_id name path"),
    "connector_event": schema("content workspace_id summary memory_type peer_id session_id metadata"),
}

# The model's enumerations.
TIERS = ("L0", "L1", "L2")
PERMISSIONS = ("read", "write", "admin")
ROLES = ("system", "user", "assistant")
