"""Ranked full-text search and corpus analytics on Spark."""
