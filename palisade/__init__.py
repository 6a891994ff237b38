"""Governed analytics on Spark."""
