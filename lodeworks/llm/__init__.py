"""Operators on names and texts; nothing outside this package imports it."""
