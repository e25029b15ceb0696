"""Retail sales analytics and forecast evaluation as Spark jobs."""
