"""Operators over companies, pages and documents."""
