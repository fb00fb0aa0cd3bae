"""Structured Streaming jobs: state from change events, change feeds, labels, counters."""
