"""Watchlist screening and identity-risk jobs on Spark DataFrames."""

__version__ = "0.1.0"
