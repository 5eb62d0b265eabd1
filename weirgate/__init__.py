"""Checking, matching and watching data with Spark DataFrames."""
