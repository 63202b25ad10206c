"""Column expressions: parsing, calendar, geography and tiers."""
