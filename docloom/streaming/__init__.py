"""Structured Streaming: indexes, replication and rates that follow a log."""
