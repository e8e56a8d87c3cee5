"""Structured Streaming: the edit log applied incrementally."""
