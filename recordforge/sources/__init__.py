"""Readers and writers of records."""
