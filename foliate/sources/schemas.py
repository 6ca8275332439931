"""The schemas of all tables and JSON inputs, in one place."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: Names and types of the columns.
_BOX = "STRUCT<page_number: INT, x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE, coordinate_origin: STRING>"
_CELL = "STRUCT<cell_id: STRING, row_index: INT, column_index: INT, text: STRING, row_span: INT, column_span: INT, is_header: BOOLEAN>"
TABLES = {
    "document_catalog": "document_id STRING, filename STRING, stored_filename STRING, source_path STRING, collection STRING, file_type STRING, size_bytes BIGINT, page_count INT, title STRING, author STRING, parse_status STRING, parse_strategy STRING, parser_name STRING, parser_version STRING, created_at TIMESTAMP_NTZ",
    "document_blocks": f"document_id STRING, block_id STRING, page_number INT, text STRING, block_type STRING, reading_order_index INT, bounding_box {_BOX}, ingested_at TIMESTAMP_NTZ",
    "document_sections": "document_id STRING, section_id STRING, parent_section_id STRING, title STRING, level INT, page_start INT, page_end INT, heading_block_id STRING, blocks ARRAY<STRING>, tables ARRAY<STRING>",
    "parsed_tables": f"document_id STRING, table_id STRING, page_number INT, page_numbers ARRAY<INT>, reading_order_index INT, cells ARRAY<{_CELL}>, caption STRING, native_text STRING, native_text_coverage DOUBLE, quality_notes ARRAY<STRING>",
    "chunks": "chunk_id STRING, document_id STRING, section_id STRING, section_path ARRAY<STRING>, content_type STRING, text STRING, page_start INT, page_end INT, source_block_ids ARRAY<STRING>, source_table_ids ARRAY<STRING>, ordinal INT",
    "chunk_embeddings": "chunk_id STRING, document_id STRING, section_id STRING, section_path ARRAY<STRING>, content_type STRING, text STRING, page_start INT, page_end INT, source_block_ids ARRAY<STRING>, source_table_ids ARRAY<STRING>, ordinal INT, content_hash STRING, embedding_model STRING, embedding_revision STRING, embedding_config_hash STRING, embedding_dimension INT, embedding ARRAY<FLOAT>",
    "evaluation": "query_id STRING, document_id STRING, question STRING, facts ARRAY<STRUCT<fact_id: STRING, locators: ARRAY<STRUCT<block_id: STRING, table_id: STRING, section_path: ARRAY<STRING>, pages: ARRAY<INT>, anchors: ARRAY<STRING>>>>>, chunk_ids ARRAY<STRING>, section_ids ARRAY<STRING>, pages ARRAY<INT>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
