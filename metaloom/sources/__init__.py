"""Readers, writers and contracts."""
