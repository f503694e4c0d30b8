"""Queries by name with their SQL oracles."""
