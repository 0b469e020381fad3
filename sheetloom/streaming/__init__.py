"""Structured Streaming forms of the run log, validation and chunk assembly."""
