"""Lodestone: evidence analytics over nested documents, built on Spark DataFrames."""
