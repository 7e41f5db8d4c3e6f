"""Structured Streaming: file events, catalog maintenance, windowed event counts."""
