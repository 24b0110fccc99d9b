"""Interval analytics and corpus operators on Spark."""
