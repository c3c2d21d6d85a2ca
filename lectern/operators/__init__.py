"""Operators over frames of posts, tokens and pages."""
