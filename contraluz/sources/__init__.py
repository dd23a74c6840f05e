"""Readers for the published files: delimited text, ZIP archives, JSON pages, landed snapshots."""
