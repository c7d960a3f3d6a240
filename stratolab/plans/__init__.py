"""Fixture views, configuration checks and registered queries."""
