"""Scans: driver tables, derived fixture views and message parsing."""
