"""Spark schemas (DDL) of the records that pass between the stages."""

from __future__ import annotations

FACT = "STRUCT<fact_type:STRING,value:STRING,confidence:STRING,source:STRING,raw_snippet:STRING>"
SOURCE = "pos INT, url STRING, doc_id STRING"
FETCH = "url STRING, doc_id STRING, status STRING, fetched_at STRING, duration_ms DOUBLE, bytes_downloaded BIGINT, error STRING"
EXTRACT = f"doc_id STRING, source_url STRING, extracted_at STRING, extraction_success BOOLEAN, fallback_to_raw BOOLEAN, error STRING, facts ARRAY<{FACT}>"
CHUNK = "chunk_id STRING, doc_id STRING, source_url STRING, chunk_type STRING, text STRING, token_count INT, overlap BOOLEAN"
EMBEDDING = "chunk_id STRING, doc_id STRING, source_url STRING, chunk_type STRING, text STRING, embedding ARRAY<FLOAT>, l2_norm DOUBLE"
STRUCTURED_FACT = "id BIGINT, doc_id STRING, source_url STRING, fact_type STRING, value STRING, confidence STRING, indexed_at STRING"
CANDIDATE = "query_id BIGINT, chunk_id STRING, doc_id STRING, source_url STRING, chunk_type STRING, text STRING, similarity DOUBLE, rank INT, retriever STRING"
CHECK = "name STRING, passed BOOLEAN, message STRING, details MAP<STRING,STRING>"
RUN = "run_id STRING, activated_at STRING, embeddings_hash STRING, paths MAP<STRING,STRING>"
RESPONSE = "query_id BIGINT, text STRING, source_url STRING, footer_date STRING, status STRING"
