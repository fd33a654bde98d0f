"""Report plans, the query registry and the SQL oracle."""
