"""End-to-end plans, derived test tables and the query catalog."""
