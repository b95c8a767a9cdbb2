"""Nodes of an event pipeline, each a function from DataFrames to DataFrames."""
