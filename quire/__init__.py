"""Quire: document-layout analytics on Spark DataFrames."""
