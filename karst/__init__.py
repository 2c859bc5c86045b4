"""Reachability, dependency and training-data analytics on Spark."""
