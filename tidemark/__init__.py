"""Posting analytics, Spark first."""
