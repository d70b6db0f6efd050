"""Citation checking and corpus preparation as Spark DataFrame jobs."""
