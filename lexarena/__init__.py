"""Judicial-decision analytics on Spark."""
