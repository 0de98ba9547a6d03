"""Spatial capture-recapture analytics as Spark DataFrame jobs."""
