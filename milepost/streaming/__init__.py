"""Structured Streaming entry points (stateless request scoring)."""
