"""Factor-risk data work as Spark DataFrame jobs."""
