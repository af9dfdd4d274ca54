"""Explicit schemas (DDL text) of every table; nothing is inferred."""

from __future__ import annotations

RULE = (
    "struct<field:string,type:string,regex:string,anchor_regex:string,stop_regex:string,"
    "columns:array<string>,strip_chars:string,date_format:string>"
)
CHECK = "struct<field:string,not_null:boolean,gt:double,lt:double,regex_match:string>"
FINGERPRINT = (
    "struct<required_keywords:array<string>,supplier_hint:string,doc_type:string,keyword_quorum:double>"
)
PAGE = "struct<page_num:int,text:string,tables:array<array<array<string>>>,sheet_name:string>"

PAGE_ROWS = (
    "doc_id string, path string, page_num int, text string, tables array<array<array<string>>>"
)
SHEET_CELLS = (
    "doc_id string, path string, sheet_idx int, sheet_name string, row_idx int, col_idx int, value string"
)
DOCS = (
    "doc_id string, path string, file_type string, full_text string, normalised_text string, "
    f"pages array<{PAGE}>, sheet_names array<string>"
)

# One row per template and snapshot. seq is the insertion order.
TEMPLATES = (
    "seq bigint, snapshot_id bigint, template_id string, required_keywords array<string>, "
    "supplier_hint string, doc_type string, keyword_quorum double, "
    f"rules array<{RULE}>, checks array<{CHECK}>, metadata map<string,string>, version int, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, hit_count bigint"
)

# The JSON layout of one stored template.
STORE_ENTRY = (
    f"struct<template_id:string,fingerprint:{FINGERPRINT},extraction_rules:array<{RULE}>,"
    f"confidence_checks:array<{CHECK}>,metadata:map<string,string>,version:int,"
    "created_at:string,updated_at:string,hit_count:bigint>"
)



def _as_text(ddl: str) -> str:
    """The same layout with numbers and booleans as text, so that "0.5" reads like 0.5."""
    for kind in ("double", "boolean", "bigint", "int"):
        ddl = ddl.replace(f":{kind}", ":string")
    return ddl


FINGERPRINT_TEXT, CHECK_TEXT, STORE_ENTRY_TEXT = map(_as_text, (FINGERPRINT, CHECK, STORE_ENTRY))

# One extracted value; exactly one of s/d/i/l/t is set, chosen by kind.
VALUE = (
    "struct<rule_pos:int,field:string,kind:string,s:string,d:double,i:bigint,"
    "l:array<string>,t:array<map<string,string>>,error:string>"
)

AUDIT = (
    "ts string, file string, file_type string, template_id string, match_score double, "
    "candidate_scores map<string,double>, result string, llm_used boolean, llm_backend string, "
    "llm_model string, validation_passed boolean, validation_errors array<string>, "
    "field_count bigint, duration_ms double, extra map<string,string>"
)

# The responder's JSON answer; extracted_data stays text per key because its keys are free.
RESPONSE_BODY = (
    f"template_id string, fingerprint {FINGERPRINT_TEXT}, extraction_rules array<{RULE}>, "
    f"confidence_checks array<{CHECK_TEXT}>, extracted_data map<string,string>"
)
RESPONSES = (
    "response_seq bigint, doc_id string, existing_template_id string, backend string, model string, raw string"
)
