"""Dependence-network analytics on Spark DataFrames."""
