"""Readers of the supported file kinds."""
