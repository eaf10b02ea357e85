"""Streams: files that arrive, events in windows."""
