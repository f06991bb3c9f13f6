"""Readers of files, topics, pages and messages."""
