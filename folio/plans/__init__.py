"""Decisions about a page from cheap measures."""
