"""Lakeleaf: document analytics on Spark DataFrames."""
