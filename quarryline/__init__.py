"""Turns tables of raw product pages into a typed product catalog, on Spark DataFrames."""
