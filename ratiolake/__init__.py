"""Everyday calculation and inspection tools as operators over Spark DataFrames."""
