"""Readers, writers and the small constant tables."""
