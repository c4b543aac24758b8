"""Operators on DataFrames: filters, joins, aggregates, ordered windows, samples and updates."""
