"""Compositions of operators: the full analysis and its report."""
