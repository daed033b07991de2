"""Readers and writers of post tables and raw pages."""
