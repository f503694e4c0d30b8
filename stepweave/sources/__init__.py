"""Readers and adapters: logs in several layouts to one step layout."""
