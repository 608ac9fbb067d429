"""Typed property-graph and text analytics on Spark DataFrames."""
