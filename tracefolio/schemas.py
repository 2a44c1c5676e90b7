"""Schemas of the engine's tables, as DDL (a parsed one would need a session at import)."""

from __future__ import annotations

FACT = (
    "fact_id string not null, document_id string not null, company_name string, ticker string, source_path string not null, metric_id string not null, "
    "metric_label string not null, source_metric_name string not null, period_type string not null, fiscal_period string not null, fiscal_year int, "
    "value double not null, unit_raw string not null, currency string, scale double, normalized_value double, normalized_unit string, evidence_page int, "
    "evidence_quote string not null, review_status string not null, source string not null, notes string"
)
FACT_STATUSES = ("verified", "needs_review")

CITATION = "struct<document_id:string,source_path:string,page_number:int,quote:string>"
FIELD = f"struct<value:string,reasoning:string,confidence:double,evidence_page:int,evidence_quote:string,citations:array<{CITATION}>>"
HEADLINE_FIELDS = ("company_name", "fiscal_period", "unit", "revenue", "net_profit", "total_assets", "total_liabilities", "roe")
HEADLINE = ("document_id string, source_path string, " + ", ".join(f"{f} {FIELD}" for f in HEADLINE_FIELDS))

PAGES = ("document_id string, page_number int, text string, markdown string, metadata map<string,string>")
EVIDENCE = (
    "document_id string, chunk_id string, chunk_kind string, page_number int, source_path string, text string, section_title string, section_type string, "
    "table_id string, row_label string, metric_tags array<string>, period_hint string"
)
CHUNK_KINDS = ("page_text", "section_text", "table_row")
REGISTRY = (
    "document_key string, local_path string, file_name string, suffix string, file_size_bytes long, checksum_sha256 string, company_name string, ticker string, "
    "market string, doc_type string, fiscal_year int, fiscal_period string, language string, industry string, source string, status string, warnings array<string>, "
    "is_supported boolean, notes string"
)
CASE = (
    "id string, tier string, company string, industry string, document_key string, query string, query_aliases array<string>, expected_route string, "
    "expected_document_evidence_intent string, primary_evidence_kind string, secondary_evidence_kinds array<string>, expected_pages array<int>, supporting_pages array<int>, "
    "expected_row_labels array<string>, expected_metric_tags array<string>, expected_section_types array<string>, expected_document_area_ids array<string>, "
    "expected_answer_field_ids array<string>, forbidden_failure_modes array<string>, answer_hygiene_checks array<string>, mvp_status string, notes string"
)
OBSERVATION = (
    "case_id string, executed boolean, route string, document_evidence_intent string, retrieval_mode string, retrieved_evidence_kinds array<string>, citation_pages array<int>, "
    "retrieved_row_labels array<string>, retrieved_metric_tags array<string>, retrieved_section_types array<string>, answer_field_ids array<string>, answer_text string, latency_ms int, error string"
)
