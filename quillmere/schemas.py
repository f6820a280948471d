"""Names that the engine's tables share. Column, type, status and phase names are those that callers know."""

from __future__ import annotations

METADATA = "struct<defines:array<string>,mentions:array<string>,aliases:array<string>>"
UNITS = (
    "id string, document_id string, source_node_id string, parent_unit_id string, source_order int, type string, name string, page int, section array<string>, "
    f"content string, content_hash string, summary string, metadata {METADATA}, metadata_terms_text string, section_path_text string, aliases_text string, "
    "subject_embedding_id string, content_embedding_id string, status string, updated_at timestamp"
)

UNIT_TYPES = ["Rule", "Image", "DataTableHeader", "DataTableRow", "ColumnListTable", "ColumnListItem"]
TABLE_TYPES = UNIT_TYPES[2:]
STATUSES = ["pending", "summary_done", "metadata_done", "embedding_done", "done"]
PHASES = ["vision", "summary", "metadata", "embedding", "concepts", "done"]
