"""Registered queries and the staged pipeline."""
