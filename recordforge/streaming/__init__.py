"""Streaming forms of the queue and log operators."""
