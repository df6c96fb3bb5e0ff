"""Retrieval, recommendation and evaluation over document tables as Spark DataFrames."""
