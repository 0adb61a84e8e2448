"""Whole requests: operators put together over one collection."""
