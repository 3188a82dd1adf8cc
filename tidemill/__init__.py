"""Evaluation of controlled-language text at scale, on Spark DataFrames."""
