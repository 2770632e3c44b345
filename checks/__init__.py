"""Independent DuckDB formulations of every query, and the comparison tool."""
