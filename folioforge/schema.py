"""Schemas of the catalogue's tables, in DDL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of resources, in order, with their types.
RESOURCE_COLUMNS = {
    "resource_id": "string", "work_id": "string", "source_id": "string", "source_type": "string", "title_original": "string", "title_ko": "string", "authors": "array<string>",
    "publisher": "string", "journal_or_series": "string", "publication_date": "date", "source_registered_date": "date", "source_modified_date": "date",
    "discovered_at": "timestamp_ntz", "downloaded_at": "timestamp_ntz", "doi": "string", "official_identifier": "string", "landing_url": "string", "download_url": "string",
    "oa_url": "string", "license": "string", "license_unknown": "boolean", "access_mode": "string", "language": "string", "document_type": "string", "topic_primary": "string",
    "keywords": "array<string>", "query_original": "string", "query_language": "string", "query_terms_expanded": "array<string>", "query_dictionary_version": "string",
    "discovered_by_query": "string", "abstract_original": "string", "file_path": "string", "file_sha256": "string", "text_sha256": "string", "file_size": "bigint",
    "text_extract_failed": "boolean", "summary_ko": "string", "summary_basis": "string", "summary_generated_at": "timestamp_ntz", "relevance_score": "int",
    "priority_level": "string",
    "score_breakdown": "struct<topic_confidence:double,topic_fit:double,source_trust:double,recency:double,practical_use:double,document_type:double,open_access:double,total:int>",
    "status": "string", "version_of": "string", "error_code": "string", "error_message": "string", "first_seen_at": "timestamp_ntz", "last_seen_at": "timestamp_ntz",
    "alerted_at": "timestamp_ntz",
}
#: What a missing value reads as.
DEFAULTS = {"access_mode": "PENDING", "document_type": "기타", "topic_primary": "99_미분류_검토필요", "priority_level": "P4", "status": "NEW", "license_unknown": True, "file_size": 0, "text_extract_failed": False, "relevance_score": 0}
RAW_ITEM = "source_id string, seq bigint, payload string, query struct<canonical_ko:string,language:string,terms:array<string>,dictionary_version:string,query_string:string>"
RUN = "run_id string, run_type string, started_at timestamp, finished_at timestamp, status string"
RUN_ITEM = "run_id string, source_id string, resource_id string, outcome string, access_mode string, error_code string"
ERROR = "run_id string, source_id string, error_code string, message string, created_at timestamp"


def default(name: str) -> Column:
    kind = RESOURCE_COLUMNS[name]
    if name in DEFAULTS:
        return F.lit(DEFAULTS[name]).cast(kind)
    if kind == "string":
        return F.lit("")
    return F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)


def as_resources(df, values: dict[str, Column]):
    """A projection on the resource columns: given values, defaults for the rest and for nulls."""
    return df.select(*[F.coalesce(values[c].cast(k), default(c)).alias(c) if c in values else default(c).alias(c) for c, k in RESOURCE_COLUMNS.items()])
