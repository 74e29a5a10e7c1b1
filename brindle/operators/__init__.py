"""Retrieval, scoring, vectors, pipelines, hybrid ranking, suggestions, spelling, highlighting."""
