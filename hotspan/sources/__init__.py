"""Reading, normalising and writing incident tables."""
