"""Readers and writers for articles, dictionaries and the ingest ledger."""
