"""Bulk eligibility analytics on Spark: profiles x rules, evaluated as DataFrames."""

__version__ = "0.1.0"
