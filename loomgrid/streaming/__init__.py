"""Structured Streaming forms of the rolling metrics."""
