"""Readers and writers for feeds, snapshots, pages and the article table."""
