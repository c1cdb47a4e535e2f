"""Rank organisations, pages and documents by text fit, declared as Spark plans."""
