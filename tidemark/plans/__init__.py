"""User-visible queries over whole tables, plus their DuckDB oracle SQL."""
