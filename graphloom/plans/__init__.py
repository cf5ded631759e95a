"""End-to-end jobs, the inputs rendered from the given tables, and the query catalogue."""
