"""Readers and writers with declared schemas; nothing infers types."""
