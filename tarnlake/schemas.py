"""Explicit table schemas."""

from __future__ import annotations

CHUNK = (
    "filename string, file_type string, file_path string, page_number int, text string, chunk_id string, parent_chunk_id string, root_chunk_id string, chunk_level int, chunk_idx int, "
    "heading_path string, heading_level int, source_start_index int, source_end_index int, content_kind string, previous_chunk_id string, next_chunk_id string, chunking_strategy string, chunking_config_hash string"
)
SECTION = "array<struct<text: string, start: int, end: int, heading_path: string, heading_level: int>>"
CANDIDATE = "query_id bigint, rank int, chunk_id string, parent_chunk_id string, chunk_level int, filename string, score double, rerank_score double"
EVAL_CASE = "case_id string, question string, question_type string, expected array<string>, facts array<string>, forbidden array<string>"
RAG_STEP = "request_id string, seq bigint, icon string, label string, detail string, ts timestamp, step_group string"
