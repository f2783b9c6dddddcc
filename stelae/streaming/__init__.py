"""Structured Streaming: windows, state and sinks over event streams."""
