"""Bulk import and export: CSV, newline-delimited JSON and GraphML."""
