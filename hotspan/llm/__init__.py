"""Operators for large text and vector tables, one module each."""
