"""Incremental document-state engine on Spark DataFrames."""
