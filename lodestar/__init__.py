"""Lodestar: document-table ingest, record linkage, cascade classification and rollup marts as Spark DataFrame operators."""
