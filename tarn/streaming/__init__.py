"""Structured Streaming forms of what the engine does in batches (an extension)."""
