"""Quire: document-layout analytics and corpus preparation on Spark DataFrames."""
