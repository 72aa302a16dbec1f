"""pathloom: urban-mobility analytics as Spark DataFrame jobs and streaming queries."""
