"""Delivery metrics over work-tracking tables, for all teams in one Spark job."""
