"""Operators: lint, graph, retrieval, ingest and maintenance."""
