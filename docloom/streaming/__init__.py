"""Streams of events: windows, sessions, deduplication, timeouts and keyed sinks."""
