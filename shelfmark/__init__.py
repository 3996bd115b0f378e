"""Shelfmark: query and process collections of documents with Spark."""
