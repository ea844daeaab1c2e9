"""Mention counts and sentiment over streams of short posts, on Spark DataFrames."""
