"""Prompt analytics on Spark."""
