"""Registered queries over collections derived from the driver tables."""
