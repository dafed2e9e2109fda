"""Marlgate: document figure-link analytics on Spark DataFrames."""
