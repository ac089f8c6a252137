"""Requests: validation, paging and rendering."""
