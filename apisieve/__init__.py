"""Capability analytics over source facts, on Spark DataFrames."""
