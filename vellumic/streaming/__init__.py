"""Streams: incremental index upkeep, and windows over events (an extension)."""
