"""Filters, joins, aggregations, windows and reshapes over the schemas of this package."""
