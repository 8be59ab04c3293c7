"""Behavioural access-log analytics expressed as Spark DataFrame jobs."""
