"""Readers, file inventory, sinks and validation history."""
