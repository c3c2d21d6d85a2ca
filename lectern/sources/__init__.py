"""Readers and writers of posts, pages, word lists and calendars."""
