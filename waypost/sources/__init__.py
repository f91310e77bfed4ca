"""Readers of the JSON and GeoJSON documents, and the constant tables."""
