"""Operators for preparing training text at scale.

Every operator is a function from DataFrames to DataFrames; ``queries.py`` registers one
query for each.  Nothing outside this folder imports it.
"""
