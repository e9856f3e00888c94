"""Grouped-evaluation and cohort-preparation operators as Spark DataFrame jobs."""
