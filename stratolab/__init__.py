"""Gridded nowcast analytics as Spark DataFrame operators."""
