"""Readers from landed JSON to typed tables, and the report sink."""
