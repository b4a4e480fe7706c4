"""Structured Streaming forms of visit counting and subscription expiry."""
