"""Training-data operators: filters, deduplication, scoring, output formats and packing.

Every operator takes a DataFrame and the names of its id and text columns, reads only
those columns (so extra or clashing columns never matter) and returns its own columns.
"""
