"""graphloom: code-graph and auth-event analytics as Spark DataFrame jobs."""
