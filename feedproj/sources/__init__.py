"""Readers, writers and the snapshot store."""
