"""Demographic statistics as PySpark DataFrame operators.

Every operator is a plain function from DataFrames to a DataFrame: it runs no action, keeps
``geo_code`` in its keys and leaves the physical plan to Catalyst and AQE. See README.md.
"""
