"""Readers: files, remote tables, cached results and the catalog."""
