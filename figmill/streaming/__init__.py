"""Structured Streaming: the engine that this one matches has no streams, so there is nothing here yet."""
