"""Query plans over the driver tables: derived inputs, the query registry and
the DuckDB oracle SQL for each query."""
