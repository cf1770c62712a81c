"""Readers and writers of episode tables."""
