"""Column expressions: dates, statistics and text."""
