"""Scan large collections of source code and other text with Spark DataFrames."""
