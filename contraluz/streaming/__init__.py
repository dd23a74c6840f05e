"""Incremental form of the monthly reload."""
