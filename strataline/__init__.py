"""Temporal fact, revision-graph and log analytics on Spark DataFrames."""
