"""graphloom: program-graph analytics as Spark DataFrame jobs."""
