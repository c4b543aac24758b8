"""Operators for building training data: one module for each, their queries in ``queries``."""
