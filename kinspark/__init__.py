"""Kinspark: entity resolution on Spark DataFrames."""
