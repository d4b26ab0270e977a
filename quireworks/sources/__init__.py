"""Readers and writers of page documents and their side tables."""
