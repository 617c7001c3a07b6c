"""Reference SQL (DuckDB) for the registered queries."""
