"""Structured Streaming forms of some operators; an extension."""
