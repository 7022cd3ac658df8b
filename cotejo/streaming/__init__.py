"""Structured Streaming forms of the counters, the two-reader join, de-duplication and last-use upkeep."""
