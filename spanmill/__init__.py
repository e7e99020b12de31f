"""Interval, evaluation and text-preparation analytics on Spark DataFrames."""
