"""Queries that bind operators to tables."""
