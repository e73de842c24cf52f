"""Tessella: evidence-style analytics written for Spark DataFrames."""
