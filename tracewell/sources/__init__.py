"""Scans that turn pages into documents."""
