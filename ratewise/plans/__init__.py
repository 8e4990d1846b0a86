"""End-to-end plans (the pricing job), query registry and DuckDB oracle SQL."""
