"""Tidemark: retail demand and inventory analytics as Spark DataFrame jobs."""
