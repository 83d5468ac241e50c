"""Strandline: longitudinal community analytics on PySpark."""
