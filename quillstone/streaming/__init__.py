"""Incremental inbox (an addition; the reference has no streams)."""
