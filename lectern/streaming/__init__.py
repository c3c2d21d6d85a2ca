"""Incremental collecting of posts."""
