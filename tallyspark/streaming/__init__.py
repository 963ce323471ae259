"""Structured Streaming jobs: incremental scoring (STR1) and request-rate audit (STR2)."""
