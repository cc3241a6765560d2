"""Jobs, service calls, registered queries and their DuckDB oracles."""
