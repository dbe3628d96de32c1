"""Recollex: memory and belief analytics, and training-data preparation, as Spark plans."""
