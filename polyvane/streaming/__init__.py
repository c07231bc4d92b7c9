"""Structured Streaming forms of additive counts."""
