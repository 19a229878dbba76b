"""Structured Streaming forms of the bars and stateful operators."""
