"""Scans and sinks: test tables, corpora, model directories."""
