"""Append-only event analytics on Spark."""
