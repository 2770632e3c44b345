"""Readers for landed files and writers for keyed, append-only and exported tables."""
