"""Whole analyses, the mapping of the given test tables, and the query registry."""
