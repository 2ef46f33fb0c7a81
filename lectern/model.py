"""Schemas and closed value sets of the document library."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
CATEGORIES = (
    "Authentication", "Session Management", "Authorization", "Token Security",
    "OAuth / OIDC / SSO", "Account Management", "Vulnerability Assessment", "Other Security",
)
RELEVANCES = ("A", "B", "C")
STATUSES = ("Unread", "Screened", "Read", "Important")
CLASSIFICATION_STATUSES = ("pending", "classified", "failed", "needs_review")
RETRIED = ("pending", "failed", "needs_review")
LABEL_FIELDS = ("tags", "research_methods", "target_vulnerabilities")
METADATA_FIELDS = ("title", "authors", "year", "venue", "abstract", "keywords", "introduction_excerpt", "metadata_sources", "review_reasons")
INPUT_FIELDS = ("title", "abstract", "keywords", "introduction_excerpt")

LINE = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1", "font_size"))])
BLOCK = T.StructType(
    [
        *LINE.fields,
        T.StructField("direction", T.StructType([T.StructField("dx", T.DoubleType()), T.StructField("dy", T.DoubleType())])),
        T.StructField("lines", T.ArrayType(LINE)),
    ]
)
SIZE = T.StructType([T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("size", SIZE)])
PARSED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("first_page_text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("first_page_blocks", T.ArrayType(BLOCK)),
        T.StructField("first_page_size", SIZE),
        T.StructField("page_layouts", T.ArrayType(PAGE)),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("year", T.IntegerType()),
        T.StructField("venue", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("introduction_excerpt", T.StringType()),
        T.StructField("metadata_sources", T.MapType(T.StringType(), T.StringType())),
        T.StructField("review_reasons", T.ArrayType(T.StringType())),
    ]
)
CLASSIFICATION = T.StructType(
    [
        T.StructField("primary_category", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("research_methods", T.ArrayType(T.StringType())),
        T.StructField("target_vulnerabilities", T.ArrayType(T.StringType())),
        T.StructField("relevance", T.StringType()),
        T.StructField("relevance_reason", T.StringType()),
        T.StructField("relevance_confidence", T.DoubleType()),
    ]
)
_SCALARS = ("primary_category", "relevance", "relevance_reason")
PAPERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("filepath", T.StringType(), False),
        *METADATA.fields,
        *(T.StructField(p + c, T.StringType()) for c in _SCALARS for p in ("ai_", "")),
        T.StructField("ai_relevance_confidence", T.DoubleType()),
        T.StructField("relevance_confidence", T.DoubleType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("manually_reviewed", T.BooleanType(), False),
        T.StructField("classification_status", T.StringType(), False),
        T.StructField("classification_error", T.StringType()),
        T.StructField("classification_provider", T.StringType()),
        T.StructField("classification_model", T.StringType()),
        T.StructField("classified_at", T.StringType()),
        T.StructField("processing_seconds", T.DoubleType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)
LABELS = T.StructType([T.StructField("paper_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("value_source", T.StringType()), T.StructField("label", T.StringType())])
RUNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("paper_id", T.LongType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("result_json", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("classified_at", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)
USER_STATE = T.StructType([T.StructField("paper_id", T.LongType()), T.StructField("is_favorite", T.BooleanType()), T.StructField("read_later", T.BooleanType())])
FOLDERS = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("name_key", T.StringType())])
PAPER_FOLDERS = T.StructType([T.StructField("paper_id", T.LongType()), T.StructField("folder_id", T.LongType())])
NOTES = T.StructType([T.StructField("paper_id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("updated_at", T.StringType())])
SCAN_RESULT = T.StructType([T.StructField(c, T.StringType()) for c in ("filename", "status", "message")] + [T.StructField("paper_id", T.LongType()), T.StructField("processing_seconds", T.DoubleType())])

TABLES = {
    "papers": PAPERS, "labels": LABELS, "classification_runs": RUNS, "paper_user_state": USER_STATE,
    "folders": FOLDERS, "paper_folders": PAPER_FOLDERS, "paper_notes": NOTES,
}
