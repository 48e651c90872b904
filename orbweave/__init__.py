"""Spatial analytics as PySpark DataFrame operators."""
